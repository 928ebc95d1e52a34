"""The registered queries, each over the whole given tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions.embedding import HashingEmbedder, embed_column
from filigree.functions.filing_paths import fiscal_year, local_path, source_url, suffix
from filigree.functions.html import markdown, sections, title
from filigree.functions.text import tokens
from filigree.operators import chats, grounding, messages, metadata
from filigree.operators.chunking import chunk_documents, chunk_sections
from filigree.operators.comparison import passage_changes
from filigree.operators.context import attach, excerpt, surrounding_chunks
from filigree.operators.filings import (
    extract_filings,
    select_annual,
    select_fallback,
    select_filings,
)
from filigree.operators.incremental import update_tables
from filigree.operators.fusion import reciprocal_rank_fusion
from filigree.operators.lexical import lexical_search, postings, term_statistics
from filigree.operators.manifest import manifest_header, manifest_rows
from filigree.operators.retrieval import (
    LIST_DEPTH,
    balanced_search,
    evidence_status,
    hybrid_search,
    search_filings,
)
from filigree.operators.semantic import semantic_search
from filigree.session import shared_dir, stored
from filigree.sinks.turns import turn_outputs
from filigree.sources import domain, tables
from filigree.sources.submissions import page_blocks, parse_pages
from filigree.streaming.ingest import ingest_available, stored_chunks
from filigree.streaming.turns import commit_available, committed_messages, failed_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


# ---- filing selection -----------------------------------------------------------


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract_filings(domain.order_pages(spark, sf))


@register
def filings_zip_extract(spark, sf):
    """Columnar pages back to one row per filing."""
    return _extracted(spark, sf)


@register
def filings_from_page_files(spark, sf):
    """Filings of all filers from page files of both shapes, joined by file name, in page order."""
    blocks = page_blocks(parse_pages(domain.page_files(spark, sf)))
    rows = extract_filings(blocks.join(domain.filers(spark, sf), "cik"))
    return rows.select("ticker", "cik", "page_ord", "row_ord", "year", "form", "accession_number", "filing_date", "report_date")


@register
def filings_year_derivation(spark, sf):
    rows = domain.order_filings(spark, sf).select(
        fiscal_year(F.col("reportDate"), F.col("filingDate")).alias("year"), "form"
    )
    return rows.groupBy("year", "form").agg(F.count(F.lit(1)).alias("n_filings"))


@register
def filings_select_annual(spark, sf):
    return select_annual(_extracted(spark, sf), domain.SELECTION)


@register
def filings_select_fallback(spark, sf):
    return select_fallback(_extracted(spark, sf), domain.SELECTION)


@register
def filings_select(spark, sf):
    """Annual filings, or the fallback forms of companies without any."""
    return select_filings(_extracted(spark, sf), domain.SELECTION)


@register
def filings_paths(spark, sf):
    rows = domain.order_filings(spark, sf).withColumn("year", fiscal_year(F.col("reportDate"), F.col("filingDate")))
    parts = [F.col(c) for c in ("year", "ticker", "form", "filingDate", "accessionNumber", "primaryDocument")]
    return rows.select(
        "accessionNumber",
        suffix(F.col("primaryDocument")).alias("suffix"),
        source_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("source_url"),
        local_path(*parts).alias("local_path"),
    )


@register
def filings_manifest(spark, sf):
    return manifest_rows(filings_select(spark, sf), ["ticker", "rank"])


@register
def filings_manifest_header(spark, sf):
    """The manifest's header with its count."""
    head = manifest_header(filings_manifest(spark, sf)).drop("generated_at_utc")
    return head.withColumns({c: F.array_join(c, ",") for c in ("annual_forms", "fallback_forms")})


@register
def filings_downloaded_counts(spark, sf):
    """Manifest entries per year folder."""
    folder = F.split("local_path", "/")[0].alias("year")
    return filings_manifest(spark, sf).groupBy(folder).agg(F.count(F.lit(1)).alias("downloaded_count"))


# ---- parsing --------------------------------------------------------------------


def _page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.pages(spark, sf)
    return pages.select("page_id", "url", markdown(F.col("html")).alias("markdown"))


@register
def html_to_markdown(spark, sf):
    return _page_markdown(spark, sf)


@register
def html_title(spark, sf):
    return tables.pages(spark, sf).select("page_id", title(F.col("html")).alias("title"))


@register
def html_sections(spark, sf):
    rows = _page_markdown(spark, sf).select("page_id", F.inline(sections(F.col("markdown"))))
    return rows.withColumnRenamed("start", "start_offset").withColumn("page", F.col("page").cast("string"))


@register
def page_chunks(spark, sf):
    """Passages of pages that keep to one section each."""
    docs = _page_markdown(spark, sf).select("page_id", sections(F.col("markdown")).alias("sections"))
    chunks = chunk_sections(docs, id_col="page_id")
    return _plain_offsets(chunks.withColumn("page", F.col("page").cast("string")))


def _plain_offsets(chunks: DataFrame) -> DataFrame:
    return chunks.withColumnsRenamed({"start": "start_offset", "end": "end_offset"})


# ---- chunks and postings --------------------------------------------------------


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_documents(tables.documents(spark, sf, "doc_id", "text"))


@register
def chunk_documents_200_150(spark, sf):
    return _plain_offsets(_document_chunks(spark, sf))


@register
def chunk_token_counts(spark, sf):
    return _document_chunks(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens")
    )


@register
def chunk_with_document_metadata(spark, sf):
    """Chunks carry their document's metadata from the start; nothing is joined."""
    docs = tables.documents(spark, sf, "doc_id", "text", "lang", "source")
    return chunk_documents(docs, keep=["lang", "source"]).select(
        "chunk_id", "doc_id", "lang", "source", F.char_length("text").alias("n_chars")
    )


@register
def postings_build(spark, sf):
    return postings(tables.documents(spark, sf, "doc_id", "text"))


@register
def corpus_term_statistics(spark, sf):
    return term_statistics(tables.documents(spark, sf, "doc_id", "text"))


# ---- comparison -----------------------------------------------------------------


@register
def passage_changes_by_source(spark, sf):
    """Every document against the next one of its source, line by line."""
    docs = tables.documents(spark, sf, "doc_id", "text", "source")
    return passage_changes(docs.withColumn("passages", F.split("text", "\n")), ["source"], "doc_id")


# ---- retrieval ------------------------------------------------------------------


def _lexical(spark: SparkSession, sf: str, depth: int = LIST_DEPTH, **options) -> DataFrame:
    docs = tables.documents(spark, sf, "doc_id", "text", "lang", "source")
    return lexical_search(docs, tables.benchmark_queries(spark, sf), depth, **options)


def _semantic(spark: SparkSession, sf: str, depth: int = LIST_DEPTH) -> DataFrame:
    return semantic_search(tables.vectors(spark, sf), tables.query_vectors(spark, sf), depth)


@register
def lexical_search_topk(spark, sf):
    return _lexical(spark, sf)


@register
def lexical_search_unicode(spark, sf):
    return _lexical(spark, sf, unicode=True)


def _chunk_hits(spark: SparkSession, sf: str, depth: int) -> DataFrame:
    return lexical_search(
        _document_chunks(spark, sf), tables.benchmark_queries(spark, sf), depth, id_col="chunk_id"
    )


@register
def lexical_search_chunks(spark, sf):
    return _chunk_hits(spark, sf, 10)


@register
def read_chunk(spark, sf):
    """The best passage of every query, read by its id."""
    hits = _chunk_hits(spark, sf, 1).select("query_id", "chunk_id")
    bound = tables.benchmark_queries(spark, sf).count()
    found = attach(hits, _document_chunks(spark, sf), "chunk_id", bound)
    return found.select("query_id", "chunk_id", "chunk_index", "text", "token_count")


@register
def surrounding_chunks_of_hits(spark, sf):
    """The three best passages of every query with the passages next to them."""
    parts = F.split("chunk_id", "-")
    hits = _chunk_hits(spark, sf, 3).select(
        "query_id", "rank", parts[0].cast("long").alias("doc_id"), parts[1].cast("int").alias("chunk_index")
    )
    bound = 3 * tables.benchmark_queries(spark, sf).count()
    around = surrounding_chunks(hits, _document_chunks(spark, sf), id_col="doc_id", hits_bound=bound)
    return around.select("query_id", "rank", "doc_id", "hit_index", "offset", "chunk_id", "text")


@register
def semantic_search_topk(spark, sf):
    return _semantic(spark, sf)


@register
def rrf_fusion(spark, sf):
    lists = {"lexical": _lexical(spark, sf), "semantic": _semantic(spark, sf)}
    return reciprocal_rank_fusion(lists, 2 * LIST_DEPTH)


def _hybrid_inputs(spark: SparkSession, sf: str):
    return (
        tables.documents(spark, sf, "doc_id", "text", "lang", "source", "n_chars"),
        tables.vectors(spark, sf),
        tables.benchmark_queries(spark, sf),
        tables.query_vectors(spark, sf),
    )


@register
def hybrid_search_topk(spark, sf):
    return hybrid_search(*_hybrid_inputs(spark, sf))


@register
def search_filings_tool(spark, sf):
    """Hybrid hits with metadata and excerpt."""
    return search_filings(*_hybrid_inputs(spark, sf), ["lang", "source", "n_chars"])


@register
def search_filtered_by_lang(spark, sf):
    return hybrid_search(*_hybrid_inputs(spark, sf), where=F.col("lang") == "en")


@register
def search_balanced_per_source(spark, sf):
    """The two best documents of every source for every query."""
    return _lexical(spark, sf, 2, facet_col="source")


@register
def search_balanced_per_source_and_lang(spark, sf):
    """Twelve hits a query, shared between the combinations of source and language."""
    return balanced_search(*_hybrid_inputs(spark, sf), ["source", "lang"], 12, depth=4)


@register
def search_by_nested_metadata(spark, sf):
    """Documents of two languages whose open metadata, the properties of the event of the
    same number, have a small or a large `k`."""
    props = tables.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.parse_json("props").alias("extra"))
    docs = tables.documents(spark, sf, "doc_id", "text", "lang").join(props, "doc_id", "left")
    wanted = {"and": [{"field": "lang", "in": ["en", "de"]}, {"or": [{"field": "k", "lt": 20}, {"field": "k", "ge": 70}]}]}
    kept = docs.where(metadata.compiled(wanted, ["doc_id", "lang"]))
    return lexical_search(kept, tables.benchmark_queries(spark, sf), 10, corpus=docs)


EVIDENCE_SCORE, EVIDENCE_COSINE = 30.0, 0.35


@register
def search_insufficient_evidence(spark, sf):
    """Evidence for every benchmark item, by strong lexical hits and by vectors other than its own."""
    lexical = _lexical(spark, sf)
    semantic = _semantic(spark, sf).where("doc_id <> query_id")
    return evidence_status(tables.benchmark_queries(spark, sf), lexical, semantic, EVIDENCE_COSINE, EVIDENCE_SCORE)


# ---- grounding ------------------------------------------------------------------

CITATION_FLOOR = 200.0


class _Evidence:
    """Each turn's retrieved passages and what its answer cites.

    Retrieved are the ten best documents for the question. Cited are those of the
    answer's twenty closest documents that were retrieved, and its closest one in any
    case when the match is very strong. Only a labelled document has a section to show.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.turns = domain.question_turns(spark, sf).withColumn("insufficient", F.char_length("answer") < 60)
        docs = tables.documents(spark, sf, "doc_id", "text")

        said = F.array(
            F.struct(F.lit("question").alias("side"), F.col("question").alias("text")),
            F.struct(F.lit("answer").alias("side"), F.col("answer").alias("text")),
        )
        asked = self.turns.select("turn_id", F.inline(said))
        # Both sides in one search: the texts are read once for the two.
        found = lexical_search(docs, asked.select(F.concat_ws(":", "side", "turn_id").alias("query_id"), "text"), 20)
        names = F.split("query_id", ":")
        found = stored(found, "turn-hits")
        found = found.select(names[0].alias("side"), names[1].alias("turn_id"), "doc_id", "score", "rank")
        self.hits = found.where((F.col("side") == "question") & (F.col("rank") <= 10)).select("turn_id", "doc_id")
        close = found.where(F.col("side") == "answer").drop("side").join(self.hits.withColumn("_asked", F.lit(True)), ["turn_id", "doc_id"], "left")
        strong = (F.col("rank") == 1) & (F.col("score") >= CITATION_FLOOR)
        self.citations = close.where(F.col("_asked") | strong).select("turn_id", "doc_id")
        labels = tables.table(spark, sf, "labels").select("doc_id", "quality")
        shown = tables.table(spark, sf, "documents").join(labels, "doc_id", "left").select(
            "doc_id",
            F.col("source").alias("company"),
            F.col("lang").alias("filing_type"),
            F.lit("2024-01-01").alias("filing_date"),
            F.lit(None).cast("int").alias("page"),
            F.concat(F.lit("quality "), "quality").alias("section"),
            excerpt(F.col("text")).alias("excerpt"),
        )
        bound = 10 * tables.table(spark, sf, "conversations").count()
        self.retrieved = attach(self.hits, shown, "doc_id", bound)

    def status(self) -> DataFrame:
        return grounding.grounding_status(self.turns, self.citations, self.retrieved, "doc_id")


@register
def citations_unretrieved(spark, sf):
    e = _Evidence(spark, sf)
    return grounding.unretrieved_citations(e.citations, e.hits, "doc_id").select("turn_id", "doc_id")


@register
def citations_missing(spark, sf):
    """Turns without any citation."""
    e = _Evidence(spark, sf)
    return e.turns.join(e.citations, "turn_id", "left_anti").select("turn_id", "insufficient")


@register
def grounding_status(spark, sf):
    return _Evidence(spark, sf).status()


@register
def citations_for_display(spark, sf):
    """Cited passages of answers that passed, with their metadata."""
    e = _Evidence(spark, sf)
    answers = grounding.grounded_answers(e.status(), e.citations, e.retrieved, "doc_id")
    return answers.select("turn_id", F.inline("cited_passages")).drop("page")


# ---- chats ----------------------------------------------------------------------


def _callers(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").where("event_type = 'click'").select("user_id").distinct()


@register
def thread_list(spark, sf):
    """Threads of the users who clicked, as callers."""
    return chats.list_threads(chats.summarize_threads(domain.message_log(spark, sf)), _callers(spark, sf))


@register
def thread_history(spark, sf):
    """Messages of the users who clicked, as callers."""
    rows = chats.thread_history(domain.message_log(spark, sf), _callers(spark, sf))
    return rows.select("thread_id", "ordinal", "user_id", "role", "text", "created_at")


@register
def thread_last_turn(spark, sf):
    return chats.last_messages(domain.message_log(spark, sf))


@register
def turn_pairs(spark, sf):
    return chats.turn_pairs(domain.message_log(spark, sf))


@register
def thread_access(spark, sf):
    """Every event as a request for the thread its properties name."""
    threads = chats.summarize_threads(domain.message_log(spark, sf))
    requests = tables.table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("thread_id"),
    )
    return chats.resolve_threads(requests, threads, ["event_id"])


@register
def document_access(spark, sf):
    """Every event as a request for the document its properties name; many don't exist."""
    requests = tables.table(spark, sf, "events").select(
        "event_id", (F.variant_get(F.parse_json("props"), "$.k", "bigint") * 7).alias("doc_id")
    )
    return chats.resolve_ids(requests, tables.table(spark, sf, "documents"), "doc_id")


@register
def ui_message_conversion(spark, sf):
    """Messages to their stored JSON form and back."""
    log = domain.message_log(spark, sf)
    stored = log.select("message_id", chats.to_ui_message(F.col("message_id"), F.col("role"), F.col("text")).alias("j"))
    return stored.select("message_id", chats.from_ui_message(F.col("j")).alias("m")).select(
        "message_id", "m.role", "m.text", F.size("m.sources").alias("n_sources")
    )


def _part_log(spark: SparkSession, sf: str) -> DataFrame:
    """Messages as parts; those at an `error` event failed."""
    log = domain.message_log(spark, sf).select(
        "message_id",
        "text",
        F.array("role").alias("sources"),
        F.when(F.col("event_type") == "error", "retrieval_failed").alias("error"),
    )
    return messages.to_parts(log)


@register
def message_parts(spark, sf):
    return _part_log(spark, sf)


@register
def message_assembly(spark, sf):
    return messages.assemble_messages(_part_log(spark, sf))


@register
def turn_persistence(spark, sf):
    """The stored messages of turns that passed, one row each."""
    return _persisted(spark, sf)["chat_messages"].select(
        "message_id", "thread_id", "user_id", "ordinal", "role",
        F.char_length(chats.from_ui_message(F.col("message_json"))["text"]).alias("n_chars"),
    )


@register
def turn_citations(spark, sf):
    """The stored citations of turns that passed."""
    return _persisted(spark, sf)["message_citations"]


@register
def turn_usage(spark, sf):
    return _persisted(spark, sf)["usage"]


def _persisted(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e = _Evidence(spark, sf)
    log = domain.message_log(spark, sf).where(F.col("role") == "user")
    owners = log.select(F.col("message_id").alias("turn_id"), "thread_id", F.col("user_id").cast("string"), "ordinal")
    turns = e.turns.join(owners, "turn_id").select(
        "*",
        F.size(tokens(F.col("question"))).alias("input_tokens"),
        F.size(tokens(F.col("answer"))).alias("output_tokens"),
    )
    return turn_outputs(turns, e.status(), e.citations.withColumnRenamed("doc_id", "chunk_id"))


# ---- streaming ------------------------------------------------------------------


@register
def incremental_ingest_availablenow(spark, sf):
    """Chunks after the documents have passed through the ingestion stream in several
    micro-batches, those with a label twice."""
    path = shared_dir(spark, "ingest")
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(tables.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    for arrival in (docs, labelled):
        arrival.write.mode("append").parquet(f"{path}/arriving")
    files = len(spark.read.schema(docs.schema).parquet(f"{path}/arriving").inputFiles())
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{path}/arriving")
    ingest_available(arriving, path)
    return _plain_offsets(stored_chunks(spark, path))


@register
def incremental_corpus_update(spark, sf):
    """Chunks of the documents after an update in which the labelled ones say their quality:
    only those are chunked and embedded again, and are of generation 2."""
    path = shared_dir(spark, "corpus")
    docs = tables.documents(spark, sf, "doc_id", "text", "lang")
    labels = tables.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" quality "), F.col("quality"))
    later = docs.join(labels, "doc_id", "left").withColumn("text", F.coalesce(said, F.col("text"))).select(*docs.columns)

    def derive(rows: DataFrame) -> DataFrame:
        return embed_column(chunk_documents(rows, keep=["lang"]), HashingEmbedder(16))

    for version in (docs, later):
        update_tables(version, path, derive, id_col="doc_id", partition="lang")
    chunks = spark.read.parquet(f"{path}/chunks")
    return _plain_offsets(chunks).select("doc_id", "chunk_id", "lang", "token_count", "start_offset", "end_offset", "generation", F.md5("text").alias("text_md5"))


@register
def streamed_message_commit(spark, sf):
    """Messages committed from a stream of parts in three micro-batches, whose parts of a
    message come in any order, and the failures without text."""
    path = shared_dir(spark, "turns")
    source = f"{path}/arriving"
    parts = _part_log(spark, sf)
    parts.withColumn("arrival", F.col("seq") % 3).write.partitionBy("arrival").parquet(source)
    files = len(spark.read.schema(parts.schema).parquet(source).inputFiles())
    arriving = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(source)
    commit_available(arriving, path)
    done = committed_messages(spark, path).select("message_id", "status", "text")
    failed = failed_messages(spark, path).select(
        "message_id", F.lit("error").alias("status"), F.lit(None).cast("string").alias("text")
    )
    return done.unionByName(failed)
