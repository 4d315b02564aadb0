"""Secret scans: certain spans by pattern, and weak ones linked by an interval join.

Everything is built-in functions. A pattern's matches and the text between them give lengths; rows per
match and a running sum give positions, so a text with many matches costs as much per match as any.
Weak candidates are reported only where complementary parts of a credential stand in the same scope:
identifiers, secrets and endpoints are binned by position and joined on text and neighbouring bins.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featureflow.sources.storage import checkpointed


class Kind(NamedTuple):
    """A pattern; `value` is the group whose length counts, `sure` spans are reported without a partner."""

    name: str
    part: str  # identifier, secret or endpoint
    sure: bool
    pattern: str
    value: int = 0
    least: int = 0
    mixed: bool = False  # upper case, lower case and digit are all needed
    hint: str = ""  # a literal every match holds


# The first three are the base patterns. Runs are matched whole, so a shortest length may stand in the pattern.
KINDS = (
    Kind("assign", "secret", True,
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Kind("access", "identifier", True, r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Kind("hex", "secret", True, r"[0-9a-f]{24,}"),
    Kind("name", "identifier", False,
         r"""(?<![A-Za-z0-9])(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""),
    Kind("random", "secret", False, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}", mixed=True),
    Kind("endpoint", "endpoint", False, r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[A-Za-z0-9._~:@%-]{3,}", hint="://"),
)
# Parts belong together when they start at most this many characters apart.
SCOPE = 300


def _found(text: str, kind: Kind) -> tuple[Column, Column]:
    """Matches with their verdict, and the lengths of the text before each match (null where there is none)."""
    body = F.col(text)
    hit = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        hit = F.when(F.contains(body, F.lit(kind.hint)), hit)
    return hit, F.transform(F.split(body, kind.pattern), lambda x: F.length(x))


def _verdict(kind: Kind, match: Column) -> Column:
    good = F.lit(True)
    if kind.least:
        good = F.length(F.regexp_extract(match, kind.pattern, kind.value)) >= kind.least
    if kind.mixed:
        for needed in ("[A-Z]", "[a-z]", "[0-9]"):
            good = good & match.rlike(needed)
    return good


def _out(n: int, kind: Kind) -> Column:
    pairs = F.arrays_zip(F.col(f"hit{n}").alias("m"), F.slice(f"gap{n}", 1, F.size(f"hit{n}")).alias("g"))
    return F.transform(
        pairs,
        lambda x, i: F.struct(
            F.lit(n).alias("kind"), i.alias("at"), x["g"].alias("gap"), F.length(x["m"]).alias("size"), _verdict(kind, x["m"]).alias("good")
        ),
    )


def _matches(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Per row one array `found` of (kind number, length before each match, match length, verdict)."""
    for n, kind in enumerate(kinds):
        hit, gaps = _found("text", kind)
        rows = rows.withColumn(f"hit{n}", hit).withColumn(f"gap{n}", F.when(F.size(f"hit{n}") > 0, gaps))
        rows = rows.withColumn(f"out{n}", _out(n, kind)).drop(f"hit{n}", f"gap{n}")
    none = F.expr("array()").cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>")
    return rows.withColumn("found", F.concat(*[F.coalesce(f"out{n}", none) for n in range(len(kinds))]))


def _linked(spans: DataFrame, kinds: tuple[Kind, ...], scope: int) -> DataFrame:
    """The weak spans with complementary parts in scope: a secret and an identifier need each other, an endpoint both."""
    parts = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (n, k.part)]), F.col("kind"))
    sure = [n for n, k in enumerate(kinds) if k.sure]
    rows = spans.withColumn("part", parts).withColumn("bin", F.floor(F.col("start") / scope))
    weak = rows.where(~F.col("kind").isin(sure))
    asked = weak.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    other = rows.where("part != 'endpoint'").select("key", "bin", F.col("start").alias("there"), F.col("part").alias("partner")).distinct()
    near = asked.join(other, ["key", "bin"]).where((F.col("partner") != F.col("part")) & (F.abs(F.col("there") - F.col("start")) <= scope))
    met = near.groupBy("key", "kind", "start", "end", "part").agg(
        F.max(F.col("partner") == "secret").alias("secret"), F.max(F.col("partner") == "identifier").alias("identifier")
    )
    return met.where(
        F.when(F.col("part") == "secret", F.col("identifier")).when(F.col("part") == "identifier", F.col("secret")).otherwise(F.col("secret") & F.col("identifier"))
    ).select("key", "kind", "start", "end")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """Append `secret_spans`, an array of (start, kind number, end, name, sure, covered), to every
    row; covered is the largest end of the spans before it.

    Positions are code points, ends exclusive; spans are ordered by start, then kind. Matches of one kind
    do not overlap; those that fail their kind's length or letters are dropped after matching. A weak
    span is there only if its partners start within `scope` characters. Null text counts as empty and
    has an empty array. Rows are told apart by id and text, so repeated rows and null ids get their
    own spans. Each text is scanned once; what moves between tasks is a row per match.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), body), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), body.alias("text"))
    found = _matches(keyed.select("key", "text"), kinds).where(F.size("found") > 0)
    narrow = checkpointed(found.select("key", "found").dropDuplicates(["key"]))
    listed = _listed(narrow, kinds, scope)
    none = F.expr("array()").cast("array<struct<start:bigint,kind:int,end:bigint,name:string,sure:boolean,covered:bigint>>")
    joined = keyed.drop("text").join(listed, "key", "left")
    return joined.select("row.*", F.coalesce("secret_spans", none).alias("secret_spans"))


def _listed(narrow: DataFrame, kinds: tuple[Kind, ...], scope: int) -> DataFrame:
    """(key, secret_spans) from the matches of each text."""
    each = narrow.select("key", F.explode("found").alias("f")).select("key", "f.*")
    so_far = Window.partitionBy("key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .where("good")
        .select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    sure = [n for n, k in enumerate(kinds) if k.sure]
    kept = spans.where(F.col("kind").isin(sure)).unionByName(_linked(spans, kinds, scope))
    names = F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (n, k.name)])
    earlier = Window.partitionBy("key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("covered", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    one = F.struct("start", "kind", "end", F.element_at(names, F.col("kind")).alias("name"), F.col("kind").isin(sure).alias("sure"), "covered")
    return kept.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("secret_spans"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", kinds: tuple[Kind, ...] = KINDS,
             scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by `mark`, overlapping spans by one; other columns and rows unchanged."""
    rows = scan(docs, doc_id, text, kinds, scope)
    piece = lambda x: F.when(
        x["start"] >= x["covered"],
        F.concat(F.substring(text, x["covered"].cast("int") + 1, (x["start"] - x["covered"]).cast("int")), F.lit(mark)),
    ).otherwise("")
    reach = F.array_max(F.transform("secret_spans", lambda x: F.greatest(x["covered"], x["end"])))
    tail = F.substring(text, reach.cast("int") + 1, F.length(text))
    whole = F.when(F.size("secret_spans") > 0, F.concat(F.array_join(F.transform("secret_spans", piece), ""), tail)).otherwise(F.col(text))
    return rows.withColumn(text, whole).select(*docs.columns)
