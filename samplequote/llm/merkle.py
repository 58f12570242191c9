"""Operator 11: a Merkle manifest of a dataset, by nested-interval labels.

Every row is a leaf: the digest of its fields, each ``-`` if null, else its
length in UTF-8 bytes, a colon and the value. The leaves of a source are ranked
by id, and every node of its tree carries the interval of leaf ranks that it
covers: a node of level k covers up to ``fan_out`` ^ k ranks, its children's
intervals are nested in its own. A level is made from the one below by grouping
at most ``fan_out`` neighbours, so no task holds a source. The subroots of the
sources are the leaves of one more such tree, in the order of the sources.

Proofs come from the top down. Each level's nodes join the parents' level on the
bucket of ranks and on containment of their interval, which attaches the parent
and all ancestors that it has been given; the siblings are what is left of the
parent's interval without the node's: the children that end before it begins and
those that begin after its end. A row so gets, for each level, the digests to the
left and to the right of its path, whose concatenation is its proof and over
which a leaf folds to the root.

A null source is a source of its own, before all others. Rows of one id are
ordered by their leaf digests; repeated rows are leaves of their own. A null id
comes first in its source, is written ``-`` and is not tampered. An empty table
gives no rows. Columns that the leaf does not name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, ordered_key, ranked, stored

#: Children of a node.
FAN_OUT = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as a leaf holds it."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field, fields)))


def build(leaves: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of the trees over ``leaves`` (tree, rank, size, digest and more), stored:
    tree, lo, hi, size, digest and, above the leaves, children."""
    level = leaves.select("*", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi")).drop("rank")
    levels = [stored(level, "merkle-0")]
    largest = levels[0].agg(F.max("size").alias("n")).first().n or 0
    width = 1
    while width < largest:
        width *= fan_out
        open_ = levels[-1].where("hi - lo < size")
        runs = open_.groupBy("tree", "size", F.floor(F.col("lo") / width).alias("run")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        levels.append(stored(runs.drop("run").withColumn("digest", digest(F.array_join("children.digest", ""))), f"merkle-{len(levels)}"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of the one node of each tree that covers all its leaves."""
    found = None
    for level in levels:
        top = level.where("hi - lo = size").select("tree", "digest")
        found = top if found is None else found.unionByName(top)
    return found


def attach(levels: list[DataFrame], tops: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """The leaves with ``steps``, the (left, right) sibling digests of each level up
    to the tree's root and from there those of ``tops`` (tree, steps and further
    columns, a row for each tree)."""
    extra = [c for c in tops.columns if c not in ("tree", "steps")]
    above = None
    for k in reversed(range(len(levels))):
        own = [c for c in levels[k].columns if c != "tree"]
        now = levels[k].where("hi - lo = size").join(tops, "tree").select("tree", *own, "steps", *extra)
        if above is not None:
            width = fan_out ** (k + 1)
            parents = above.select("tree", F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("children").alias("family"),
                                   "steps", *extra, F.floor(F.col("lo") / width).alias("bucket"))
            nodes = levels[k].where("hi - lo < size").withColumn("bucket", F.floor(F.col("lo") / width))
            inside = (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            step = F.struct(
                F.array_join(F.transform(F.filter("family", lambda c: c["hi"] <= F.col("lo")), lambda c: c["digest"]), "").alias("left"),
                F.array_join(F.transform(F.filter("family", lambda c: c["lo"] >= F.col("hi")), lambda c: c["digest"]), "").alias("right"))
            below = (nodes.join(parents, ["tree", "bucket"]).where(inside)
                     .withColumn("steps", F.concat(F.array(step), F.col("steps"))).select("tree", *own, "steps", *extra))
            now = now.unionByName(below)
        above = stored(now, f"merkle-paths-{k}") if k else now
    return above


def proof(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def manifest(docs: DataFrame, fields: tuple = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             changed: tuple | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, leaf, subroot, root, steps and changed_leaf of each row. ``changed`` is
    (condition, field, Column): rows that meet the condition have changed_leaf, the
    leaf with that field replaced; others null."""
    parts = [F.col(c) for c in fields]
    other = F.lit(None).cast("string")
    if changed:
        condition, name, value = changed
        other = F.when(condition, leaf_digest([value if c == name else F.col(c) for c in fields]))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), ordered_key(F.col(source_col)).alias("tree"),
                              leaf_digest(parts).alias("digest"), other.alias("changed_leaf"))
                  .withColumn("row", F.monotonically_increasing_id()), "merkle-rows")
    levels = build(ranked(rows, "tree", ["doc_id", "digest", "row"], "merkle-ranked"), fan_out)
    subroots = roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    forest = build(ranked(subroots, "tree", ["source"], "merkle-sources"), fan_out)
    top = roots(forest).select("tree", F.array().cast(_STEPS).alias("steps"), F.col("digest").alias("root"))
    tops = attach(forest, top, fan_out).select(F.col("source").alias("tree"), "steps", F.col("digest").alias("subroot"), "root")
    return attach(levels, stored(tops, "merkle-tops"), fan_out).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "steps", "changed_leaf")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    rows = manifest(docs, changed=(tampered, "text", F.translate(F.col("text"), _UPPER, _LOWER)))
    rows = rows.withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("steps")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """DuckDB SQL for up to 16^source_levels rows of a source and 16^top_levels sources."""
    def h(c, name):
        return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"

    def tree(p: str, depth: int) -> str:
        out = []
        for k in range(depth):
            out.append(f"{p}{k + 1} as (select source, n, i // {FAN_OUT} as i, sha256(string_agg(digest, '' order by i)) as digest "
                       f"from {p}{k} where n > {FAN_OUT ** k} group by source, n, i // {FAN_OUT})")
        family = f"partition by source, i // {FAN_OUT} order by i rows between"
        for k in range(depth):
            out.append(f"{p}s{k} as (select source, i, coalesce(string_agg(digest, '') over ({family} unbounded preceding and 1 preceding), '') as l, "
                       f"coalesce(string_agg(digest, '') over ({family} 1 following and unbounded following), '') as r "
                       f"from {p}{k} where n > {FAN_OUT ** k})")
        out.append(f"{p}root as (" + " union all ".join(
            f"select source, digest from {p}{k} where n <= {FAN_OUT ** k}" + (f" and n > {FAN_OUT ** (k - 1)}" if k else "") for k in range(depth + 1)) + ")")
        return ",\n".join(out)

    leaf = " || ".join(h(c, c) for c in FIELDS)
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    changed = leaf.replace("cast(text as", f"cast({lower} as")
    joins = "".join(f"\nleft join as{k} a{k} on a{k}.source is not distinct from d.source and a{k}.i = d.i // {FAN_OUT ** k}" for k in range(source_levels))
    joins += "".join(f"\nleft join bs{k} b{k} on b{k}.i = t.i // {FAN_OUT ** k}" for k in range(top_levels))
    steps = [f"a{k}" for k in range(source_levels)] + [f"b{k}" for k in range(top_levels)]
    proof_ = " || ".join(f"coalesce({s}.l || {s}.r, '')" for s in steps)
    folds, last = [], "coalesce(changed, leaf)"
    for n, s in enumerate(steps):
        folds.append(f"f{n} as (select *, case when {s}_l is null then {last} else sha256({s}_l || {last} || {s}_r) end as v{n} from {f'f{n - 1}' if n else 'paths'})")
        last = f"v{n}"
    named = ", ".join(f"{s}.l as {s}_l, {s}.r as {s}_r" for s in steps)
    return f"""
with d as (select doc_id, source, sha256({leaf}) as leaf,
       case when crc32_of % 5 = 0 then sha256({changed}) end as changed
       from (select *, {_crc_sql('cast(doc_id as varchar)')} as crc32_of from documents)),
d0 as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as i, count(*) over (partition by source) as n from d),
a0 as (select source, n, i, leaf as digest from d0),
{tree('a', source_levels)},
b0 as (select null as source, count(*) over () as n, row_number() over (order by source nulls first) - 1 as i, digest, source as name from aroot),
{tree('b', top_levels)},
paths as (select d.doc_id, d.leaf, d.changed, t.digest as subroot, (select digest from broot) as root, sha256({proof_}) as proof_sha256, {named}
from d0 d join b0 t on t.name is not distinct from d.source{joins}),
{", ".join(folds)}
select doc_id, leaf, subroot, root, proof_sha256, {last} as folded_root, {last} = root as verified from f{len(steps) - 1}
"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII text in DuckDB SQL, a bit at a time."""
    step = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return ("xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split("
            + text + ", ''), lambda ch: cast(ascii(ch) as bigint))), lambda acc, b: "
            "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, bit: " + step + ")), 4294967295)")
