"""Nested request documents: reading, building from flat rows, serialising.

A proposal can be arbitrarily large (one may hold a third of all rows). There are
two ways out of flat rows, and neither collects a whole proposal into one group:

* ``nest_requests`` builds typed documents in pages of about ``page_size``
  audiences: a per-proposal count (partial aggregation) decides how many pages a
  proposal gets, and each audience goes to a page by hash. Where the rows of a proposal
  lie together already, its document is formed there, from runs of bounded length, and
  only proposals cut by a run's end or over ``page_size`` move.
* ``write_request_documents`` streams each proposal as one JSON document into a
  line of text: its rows move once, each becomes a fragment of text, and a task writes the
  sorted fragments, with those that open and close countries, one after the other. So a
  document is not bounded by a row or a task's memory, nor cut at any size. One task
  writes a line. ``read_request_documents`` reads such lines in parts.

Each page says which of how many it is, and each of its countries how many
audiences the whole proposal has there, so that nothing computed from a page
depends on the page size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.broadcast import fits_broadcast, stored_lookup
from ..operators.ordering import rank_rows
from ..schemas import (ACCOUNT_RENAMES, AUDIENCE_RENAMES, COST_RENAMES,
                       COUNTRY_RENAMES, PROPOSAL_FIELDS, REQUEST_DDL)

DEFAULT_PAGE_SIZE = 500
#: Characters after which ``read_request_documents`` begins the next part of a document.
PART_CHARS = 64 << 10
#: What sets the fragments of a document apart: JSON allows it between its texts and escapes it in them.
FRAGMENT_SEP = "\t"
#: Rows that a part of a document holds at most where documents are formed in place.
RUN_ROWS = 50_000
#: Documents of several pages or parts, and their countries, that are broadcast at most.
MAX_BROADCAST_PAGED = 100_000
_COUNTRY = list(COUNTRY_RENAMES.values())[0]
_NULLS = {"ignoreNullFields": "false"}
_DOC = ["_d1", "_d2"]
_HEAD, _COUNTRY_HEAD = '{"proposal_id":', '{"country_code":'


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines request documents with the explicit request schema."""
    return spark.read.schema(REQUEST_DDL).json(path)


def parse_requests(df: DataFrame, column: str = "value") -> DataFrame:
    """Request documents held as JSON text in ``column`` -> typed rows."""
    return df.select(F.from_json(F.col(column), REQUEST_DDL).alias("_r")).select("_r.*")


def _document() -> Column:
    """Every proposal-level field: the document without its countries."""
    costs = F.struct(*[F.col(v).alias(k) for k, v in COST_RENAMES.items()]).alias("total_costs")
    account = F.struct(*[F.col(v).alias(k) for k, v in ACCOUNT_RENAMES.items()]).alias("account")
    return F.struct(*[F.col(c) for c in PROPOSAL_FIELDS], costs, account)


def _audience() -> Column:
    return F.struct(*[F.col(v).alias(k) for k, v in AUDIENCE_RENAMES.items()])


def _keyed(flat: DataFrame, *keep: Column) -> DataFrame:
    """Rows of document, country and audience, with the document's key: two
    independent hashes of all its fields, 128 bits together; and the columns ``keep``."""
    fields = [F.col(c) for c in (*PROPOSAL_FIELDS, *COST_RENAMES.values(), *ACCOUNT_RENAMES.values())]
    return flat.select(F.xxhash64(*fields).alias("_d1"), F.xxhash64(F.lit("document"), *reversed(fields)).alias("_d2"),
                       _document().alias("_document"), F.col(_COUNTRY).alias("_country"), _audience().alias("_audience"), *keep)


def nest_requests(flat: DataFrame, page_size: int = DEFAULT_PAGE_SIZE, together: bool = False) -> DataFrame:
    """Flat audience rows -> request documents (the inverse of
    ``flatten_request``), one document per proposal page.

    Rows are stored once, counted by document, and shuffled once, by document and
    page. Only the countries of documents of several pages are counted: where those
    documents are few they are broadcast, so the rows do not move for them.

    ``together`` says that the rows of a ``proposal_id`` lie together, as after a join by
    it: then documents are formed and stored there, and only those move that a run of
    ``RUN_ROWS`` rows cut or that have several pages. The documents are the same either
    way; for rows that lie apart it moves more."""
    if together:
        return _nest_in_place(flat, page_size)
    rows = stored_lookup(_keyed(flat), "request-rows")
    sizes = rows.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > page_size)
    paged = stored_lookup(sizes.select(*_DOC, F.ceil(F.col("_n") / page_size).cast("int").alias("_pages")), "request-pages")
    return _nest_pages(rows, paged)


def _nest_in_place(flat: DataFrame, page_size: int) -> DataFrame:
    run = F.floor(F.monotonically_increasing_id() / RUN_ROWS)
    rows = _keyed(flat.sortWithinPartitions("proposal_id"), F.col("proposal_id"), run.alias("_run"))
    item = F.struct(F.col("_country").alias("c"), F.col("_audience").alias("a"))
    formed = (rows.groupBy("proposal_id", *_DOC, "_run")
              .agg(F.any_value("_document").alias("_document"), F.count(F.lit(1)).alias("_n"), F.collect_list(item).alias("_items")))
    # A proposal of very many rows is split among tasks, though its runs then move.
    skewed, conf = "spark.sql.adaptive.forceOptimizeSkewedJoin", flat.sparkSession.conf
    before = conf.get(skewed)
    conf.set(skewed, "true")
    try:
        parts = stored_lookup(formed.select(*_DOC, "_document", "_n", "_items"), "request-parts")
    finally:
        conf.set(skewed, before)
    sizes = parts.groupBy(*_DOC).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_parts"))
    cut = stored_lookup(sizes.where((F.col("_n") > page_size) | (F.col("_parts") > 1))
                        .select(*_DOC, F.ceil(F.col("_n") / page_size).cast("int").alias("_pages")), "request-pages")
    if cut.isEmpty():
        whole, rest = parts, None
    else:
        few = F.broadcast(cut) if fits_broadcast(cut, MAX_BROADCAST_PAGED) else cut
        whole = parts.join(few, _DOC, "left_anti")
        rest = (parts.join(few.select(*_DOC), _DOC, "left_semi").select(*_DOC, "_document", F.explode("_items").alias("_i"))
                .select(*_DOC, "_document", F.col("_i.c").alias("_country"), F.col("_i.a").alias("_audience")))
    docs = _documents(whole.withColumns({"page_no": F.lit(0), "page_count": F.lit(1)}), False)
    return docs if rest is None else docs.unionByName(_nest_pages(rest, cut.where("_pages > 1")))


def _nest_pages(rows: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows of ``_keyed`` -> documents; those in ``paged`` have ``_pages`` pages, others one."""
    if paged.isEmpty():
        rows, count = rows.withColumn("_pages", F.lit(1)), []
    else:
        few = F.broadcast(paged) if fits_broadcast(paged, MAX_BROADCAST_PAGED) else paged
        counts = stored_lookup(rows.select(*_DOC, "_country").join(few, _DOC).groupBy(*_DOC, "_country", "_pages")
                               .agg(F.count(F.lit(1)).alias("_cc")), "request-counts")
        of_paged = counts.select(*[F.col(d).alias(f"_p{d}") for d in _DOC], F.col("_country").alias("_pc"), "_cc", "_pages")
        if fits_broadcast(of_paged, MAX_BROADCAST_PAGED):
            of_paged = F.broadcast(of_paged)
        same = (F.col("_d1") == F.col("_p_d1")) & (F.col("_d2") == F.col("_p_d2")) & F.col("_country").eqNullSafe(F.col("_pc"))
        rows = rows.join(of_paged, same, "left").withColumn("_pages", F.coalesce("_pages", F.lit(1)))
        count = [F.col("_cc").alias("n")]
    page = F.when(F.col("_pages") > 1, F.pmod(F.xxhash64("_audience", "_country"), F.col("_pages")).cast("int")).otherwise(0)
    # One aggregation per page; countries are then formed inside the page
    # (at most about page_size audiences) with array functions.
    items = (rows.groupBy(*_DOC, page.alias("page_no"))
             .agg(F.any_value("_document").alias("_document"), F.any_value("_pages").alias("page_count"),
                  F.collect_list(F.struct(F.col("_country").alias("c"), *count, F.col("_audience").alias("a"))).alias("_items")))
    return _documents(items, bool(count))


def _documents(items: DataFrame, counted: bool) -> DataFrame:
    """Pages with their ``_items`` -> documents; ``counted``: each item has its country's count."""
    def code_of(x):
        return F.struct(x["c"].alias("c"), (x["n"] if counted else F.lit(None).cast("long")).alias("n"))
    codes = F.array_sort(F.array_distinct(F.transform("_items", code_of)))
    countries = F.transform(codes, lambda code: F.struct(code["c"].alias("country_code"), code["n"].alias("n"),
        F.array_sort(F.transform(F.filter("_items", lambda x: x["c"].eqNullSafe(code["c"])), lambda x: x["a"])).alias("audiences")))
    country = F.transform(F.col("_countries"), lambda c: F.struct(
        c["country_code"].alias("country_code"), F.coalesce(c["n"], F.size(c["audiences"]).cast("long")).alias("country_audiences"),
        c["audiences"].alias("audiences")))
    return items.withColumn("_countries", countries).select("_document.*", "page_no", "page_count", country.alias("countries"))


def request_json(requests: DataFrame) -> DataFrame:
    """One JSON document per request, NULL fields written as ``null``."""
    return requests.select(
        F.col("proposal_id"), F.col("revision_number"),
        F.to_json(F.struct(*[F.col(c) for c in requests.columns]), _NULLS).alias("json"))


def write_requests(requests: DataFrame, path: str, mode: str = "errorifexists",
                   compression: str = "gzip", file_rows: int = 20_000) -> str:
    """Write request documents as JSON lines (NULLs kept), compressed, at most
    ``file_rows`` documents to a file (a gzip file is read by one task)."""
    (requests.write.mode(mode).option("ignoreNullFields", "false")
     .option("compression", compression).option("maxRecordsPerFile", file_rows).json(path))
    return path


def request_fragments(flat: DataFrame, document_rows: int | None = None) -> DataFrame:
    """``_d1, _d2, page_no, fragment``: the JSON documents in fragments, each document's in
    one partition and in order. A fragment is an audience, or what opens or closes a
    country (and the document, if it is its first or last).

    Rows are stored once, as they are counted by document and country before they move.
    They move once, by document, and are sorted there; what opens and closes the countries
    comes as rows of its own, so that no row is joined to its document. Only
    where ``document_rows`` is given are rows ranked, to cut documents there."""
    n = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(flat).withColumn("_head", F.to_json("_document", _NULLS)).drop("_document")
    rows = stored_lookup(keyed, "fragment-rows")
    if document_rows is None:
        rows = rows.withColumns({"page_no": F.lit(0), "page_count": F.lit(1)})
    else:
        ranked = rank_rows(rows.withColumn("_json", F.to_json("_audience", _NULLS)), _DOC, ["_country", "_json"], "request-fragments")
        rows = ranked.withColumns({"page_no": F.floor(F.col("rank") / document_rows).cast("int"),
                                   "page_count": F.ceil(F.col("size") / document_rows).cast("int")})
    key = [*_DOC, "page_no"]
    place = [*key, "_country", "_kind", "_json"]
    audiences = rows.select(*key, "_country", F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_text"), "_audience")
    marks = _marks(rows, key).withColumn("_audience", F.lit(None).cast(audiences.schema["_audience"].dataType))
    dealt = (audiences.unionByName(marks).repartition(n, *key)
             .select(*place[:-1], F.coalesce("_text", F.to_json("_audience", _NULLS)).alias("_json")).sortWithinPartitions(*place))
    # a window is the audiences of one country; its rows lie sorted already
    before = F.lag("_kind").over(Window.partitionBy(*place[:-1]).orderBy("_json"))
    comma = F.when((F.col("_kind") == 1) & F.col("_before").isNotNull(), F.lit(",")).otherwise(F.lit(""))
    return dealt.withColumn("_before", before).select(*key, F.concat(comma, "_json").alias("fragment"))


def _marks(rows: DataFrame, key: list[str]) -> DataFrame:
    """What opens and closes each country of each document: rows of kind 0 and 2."""
    counted = rows.groupBy(*key, "page_count", "_head", "_country").agg(F.count(F.lit(1)).alias("_n"))
    found = stored_lookup(counted.groupBy(*key, "page_count", "_country").agg(F.min("_head").alias("_head"), F.sum("_n").alias("_n")),
                          "request-countries")
    of_page = Window.partitionBy(*key)
    nth, last = F.row_number().over(of_page.orderBy("_country")), F.count(F.lit(1)).over(of_page)
    countries = found.select(*key, "_country", "page_count", F.min("_head").over(of_page).alias("_head"), nth.alias("_nth"), last.alias("_last"),
                             F.sum("_n").over(Window.partitionBy(*_DOC, "_country")).alias("_n"))
    begins = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(',"page_no":'), F.col("page_no").cast("string"),
                      F.lit(',"page_count":'), F.col("page_count").cast("string"), F.lit(',"countries":[' + FRAGMENT_SEP))
    country = F.concat(F.lit(_COUNTRY_HEAD), F.expr("coalesce(substring(to_json(array(_country)), 2, length(to_json(array(_country))) - 2), 'null')"),
                       F.lit(',"country_audiences":'), F.col("_n").cast("string"), F.lit(',"audiences":['))
    opens = F.concat(F.when(F.col("_nth") == 1, begins).otherwise(F.lit(",")), country)
    closes = F.when(F.col("_nth") == F.col("_last"), F.lit("]}]}\n")).otherwise(F.lit("]}"))
    mark = F.explode(F.array(F.struct(F.lit(0).alias("k"), opens.alias("t")), F.struct(F.lit(2).alias("k"), closes.alias("t"))))
    return countries.select(*key, "_country", mark.alias("_m")).select(*key, "_country", F.col("_m.k").alias("_kind"), F.col("_m.t").alias("_text"))


def write_request_documents(flat: DataFrame, path: str, document_rows: int | None = None, mode: str = "errorifexists",
                            compression: str = "gzip") -> str:
    """Flat audience rows -> JSON lines of one document per proposal, of whatever size,
    streamed from sorted fragments. Fragments are set apart by a tab, which JSON allows
    between and never within its texts. ``document_rows`` cuts proposals of more
    audiences into several documents (pages), for readers that need them short."""
    (request_fragments(flat, document_rows).select("fragment")
     .write.mode(mode).option("lineSep", FRAGMENT_SEP).option("maxRecordsPerFile", 0).option("compression", compression).text(path))
    return path


def read_request_documents(spark: SparkSession, path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """What ``write_request_documents`` wrote as typed rows, a document in parts of about
    ``part_chars`` characters: a part has the document's fields, ``part_no`` from 0 on and
    the next countries and audiences (a country that goes on comes again). Thus a document
    is read whatever its size, where ``read_requests`` holds a line in memory. A file is
    read by one task from its start; a file of a codec that Spark splits is refused."""
    fragments = spark.read.option("lineSep", FRAGMENT_SEP).text(path)
    parts = fragments.mapInArrow(_parts(part_chars), "part_no int, json string")
    return parts.select(F.from_json("json", REQUEST_DDL).alias("_r"), "part_no").select("_r.*", "part_no")


def _parts(part_chars: int):
    """Batches of fragments in order -> batches of (part_no, text of a smaller document)."""
    head_of, country_of = _HEAD, (_COUNTRY_HEAD, "," + _COUNTRY_HEAD)

    def run(batches):
        import pyarrow as pa
        head = country = None
        texts, size, part, bare = [], 0, 0, True  # bare: no audience since a beginning
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                if head is None:
                    if not text.startswith(head_of):
                        raise ValueError("a document does not begin where its file is read: the files are split or not of write_request_documents")
                    head, texts, size, part, bare = text, [text], len(text), 0, True
                    continue
                if text.startswith("]"):
                    texts.append(text)
                    if text.endswith("\n"):
                        found.append((part, "".join(texts)))
                        head = None
                    continue
                opens = text.startswith(country_of)
                if size >= part_chars and not bare:
                    texts.append("]}" if opens else "]}]}")
                    found.append((part, "".join(texts)))
                    texts, part, text = [head] if opens else [head, country], part + 1, text.removeprefix(",")
                    size = sum(map(len, texts))
                if opens:
                    country = text.removeprefix(",")
                bare = opens
                texts.append(text)
                size += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string())],
                                             names=["part_no", "json"])
        if head is not None:
            raise ValueError("a document does not end where its file is read: the files are split or not whole")
    return run


def count_request_documents(spark: SparkSession, path: str) -> DataFrame:
    """``proposal_id, documents``: the documents that ``write_request_documents`` wrote, by
    their beginnings."""
    heads = spark.read.option("lineSep", FRAGMENT_SEP).text(path).where(F.col("value").startswith(_HEAD))
    ids = parse_requests(heads.select(F.concat("value", F.lit("]}")).alias("value"))).select("proposal_id")
    return ids.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("documents"))
