"""A page as Markdown, by its structure: headings, nested lists, links, tables as grids.

One pass over the page, in time that grows with its length also where it is broken. Open
elements that matter are kept on stacks; nothing recurses.
"""
from __future__ import annotations

import html as entities
import re

PAGE_BREAK = "\f"
DROPPED = {"script", "style", "noscript", "head", "nav", "template"}
BLOCKS = set(
    "p div article section main header footer aside blockquote form hr body html address figure figcaption fieldset center dl caption".split()
)
NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
BREAKING = re.compile(r"(?:page-break-(?:before|after)\s*:\s*always|break-(?:before|after)\s*:\s*page)", re.I)
BLANKS = re.compile(r"[ \t\r\n\f\xa0]+")
LINES = re.compile(r" *\n *")
MAX_SPAN = 1000


class _Table:
    """The cells of a table, put on a grid when it ends."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.open = False  # whether a cell, or the caption, takes text
        self.span: tuple[int, int] | None = (1, 1)  # of the open cell; None in the caption
        self.caption = ""

    def grid(self) -> list[list[str]]:
        """Rows of equally many texts; spanned places are empty, columns without text left out."""
        placed, taken = [], {}  # taken: column -> first row in which it is free again
        for r, row in enumerate(self.rows):
            at, found = 0, {}
            for text, across, down in row:
                while taken.get(at, 0) > r:
                    at += 1
                found[at] = text
                if down > 1:
                    taken |= {c: r + down for c in range(at, at + across)}
                at += across
            placed.append(found)
        columns = sorted({c for row in placed for c, text in row.items() if text})
        return [[row.get(c, "") for c in columns] for row in placed if any(row.values())]


def table_lines(grid: list[list[str]]) -> str:
    """A pipe table whose first row is the header; a single column as paragraphs."""
    if not grid:
        return ""
    if len(grid[0]) == 1:
        return "\n\n".join(row[0] for row in grid)
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in row) + " |" for row in grid]
    return "\n".join([lines[0], "|" + " --- |" * len(grid[0]), *lines[1:]])


class _Writer:
    def __init__(self):
        self.blocks: list[tuple[str, bool]] = []  # text, whether it is a line of a list
        self.buffer: list[str] = []
        self.prefix, self.breaks, self.quotes, self.pre = "", "", 0, 0
        self.lists: list[list] = []  # [is ordered, number of the last item]
        self.links: list[tuple[int, str]] = []
        self.tables: list[tuple[_Table, list]] = []  # with the buffer around each

    def flush(self, line: bool = False) -> None:
        text = "".join(self.buffer)
        self.buffer, self.links = [], []
        if self.pre:
            text = f"```\n{text.strip(chr(10))}\n```" if text.strip() else ""
        else:
            text = re.sub(r"\n{3,}", "\n\n", LINES.sub("\n", text)).strip(" \n")
        if not text:
            return
        if self.quotes:
            text = "\n".join(f"{'> ' * self.quotes}{part}".rstrip() for part in text.split("\n"))
        item, self.prefix = self.prefix, ""
        indent = "  " * (len(self.lists) - 1) if self.lists and not item.startswith("#") else ""
        if self.lists and not item and not line:
            indent += "  "  # goes on within an item
        text = indent + item + text
        self.blocks.append((self.breaks + text, bool(self.lists) or line))
        self.breaks = ""

    def text(self, raw: str) -> None:
        if self.tables and not self.tables[-1][0].open:
            return
        said = entities.unescape(raw)
        if self.pre:
            self.buffer.append(said)
            return
        said = BLANKS.sub(" ", said)
        if said.startswith(" ") and (not self.buffer or self.buffer[-1].endswith((" ", "\n"))):
            said = said[1:]
        if said:
            self.buffer.append(said)

    def end_cell(self) -> None:
        table, _ = self.tables[-1]
        if table.open:
            text = BLANKS.sub(" ", "".join(self.buffer)).strip()
            if table.span:
                table.rows[-1].append((text, *table.span))
            else:
                table.caption = text
            table.open, self.buffer, self.links = False, [], []

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if BREAKING.search(attributes.get("style", "")):
            if not self.tables:
                self.flush()
            self.breaks += PAGE_BREAK
        if self.tables and self.in_table(name, attributes):
            return
        if name == "table":
            if not self.tables:
                self.flush()
            self.tables.append((_Table(), self.buffer))
            self.buffer = []
        elif self.tables:
            if name == "br" or name in BLOCKS or name == "li":
                self.buffer.append(" ")
            elif name == "a":
                self.links.append((len(self.buffer), attributes.get("href", "")))
        elif name == "br":
            self.buffer.append("\n")
        elif name == "a":
            self.links.append((len(self.buffer), attributes.get("href", "")))
        elif re.fullmatch("h[1-6]", name):
            self.flush()
            self.prefix = "#" * int(name[1]) + " "
        elif name in ("ul", "ol"):
            self.flush()
            start = attributes.get("start", "1")
            self.lists.append([name == "ol", int(start) - 1 if start.isdigit() else 0])
        elif name == "li":
            self.flush()
            self.lists = self.lists or [[False, 0]]
            self.lists[-1][1] += 1
            self.prefix = f"{self.lists[-1][1]}. " if self.lists[-1][0] else "- "
        elif name in ("dt", "dd"):
            self.flush(line=True)
        elif name == "pre":
            self.flush()
            self.pre += 1
        elif name in BLOCKS:
            self.flush()
            self.quotes += name == "blockquote"

    def in_table(self, name: str, attributes: dict[str, str]) -> bool:
        table, _ = self.tables[-1]
        if name in ("tr", "td", "th"):
            self.end_cell()
            if name == "tr" or not table.rows:
                table.rows.append([])
            if name != "tr":
                spans = [attributes.get(s, "1") for s in ("colspan", "rowspan")]
                table.span = tuple(min(max(int(s), 1), MAX_SPAN) if s.isdigit() and len(s) < 6 else 1 for s in spans)
                table.open = True
            return True
        if name == "caption":
            self.end_cell()
            table.open, table.span = True, None
            return True
        return False

    def end(self, name: str) -> None:
        if name == "table" and self.tables:
            self.end_cell()
            table, around = self.tables.pop()
            self.buffer = around
            grid = table.grid()
            if self.tables:
                self.buffer.append(" " + " ".join([table.caption, *(c for row in grid for c in row if c)]) + " ")
                return
            for block in (table.caption, table_lines(grid)):
                if block:
                    self.blocks.append((self.breaks + block, False))
                    self.breaks = ""
        elif name == "a" and self.links:
            at, href = self.links.pop()
            said = "".join(self.buffer[at:])
            if href and said.strip() and "\n" not in said and not href.lower().startswith(("#", "javascript:")):
                lead = " " if said.startswith(" ") else ""
                tail = " " if said.endswith(" ") else ""
                self.buffer[at:] = [f"{lead}[{said.strip()}]({href.strip().replace(' ', '%20').replace(')', '%29')}){tail}"]
        elif self.tables:
            if name in ("td", "th", "tr", "caption"):
                self.end_cell()
        elif re.fullmatch("h[1-6]", name):
            self.flush()
            self.prefix = ""
        elif name in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
            self.prefix = ""
        elif name == "li":
            self.flush()
            self.prefix = ""
        elif name in ("dt", "dd"):
            self.flush(line=True)
        elif name == "pre":
            self.flush()
            self.pre = max(0, self.pre - 1)
        elif name in BLOCKS:
            self.flush(line=name == "dl")
            self.quotes -= name == "blockquote" and self.quotes > 0

    def done(self) -> str:
        while self.tables:
            self.end("table")
        self.flush()
        out = []
        for i, (text, line) in enumerate(self.blocks):
            if i:
                out.append("\n" if line and self.blocks[i - 1][1] else "\n\n")
            out.append(text)
        return "".join(out) + self.breaks


def page_markdown(page: str | None) -> str | None:
    """The Markdown of a page.

    Scripts, styles, the head and navigation are left out, as are tags and comments; text,
    also of unknown elements, stays. References of any HTML name or number are decoded. A
    table's first row is its header. An element that asks for a page break puts a form feed
    before the next block.
    """
    if page is None:
        return None
    writer, at, lowered = _Writer(), 0, page.lower()
    last, quoted, never = page.rfind(">"), True, set()
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            writer.text(page[at:])
            break
        if begin > at:
            writer.text(page[at:begin])
        found = NAME.match(page, begin)
        if not found:
            if page.startswith("<!--", begin) and "-->" not in never:
                end = page.find("-->", begin + 4)
                if end >= 0:
                    at = end + 3
                    continue
                never.add("-->")
            if page[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = page.find(">", begin) + 1
            else:
                writer.text("<")
                at = begin + 1
            continue
        rest = REST.match(page, found.end()) if quoted else None
        if rest is None:
            quoted = False  # a quote never ends: from here on, tags end at the first bracket
        at = rest.end() if rest else page.find(">", begin) + 1
        closing, name = found[1], found[2].lower()
        if closing:
            writer.end(name)
            continue
        if name in DROPPED and name not in never:
            end = lowered.find(f"</{name}", at)
            if end >= 0:
                at = page.find(">", end) + 1 or len(page)
                continue
            never.add(name)
        attributes = page[found.end() : at]
        writer.start(name, {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {})
    return writer.done()
