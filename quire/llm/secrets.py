"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Spans of three base kinds are found with one regular expression each.  Positions come from what lies between matches:
``split`` gives the pieces, ``regexp_extract_all`` the matches, and a fold over both sums code points.  On top of
them, kind ``live`` adds credential-shaped strings (long, mixed case and digits) that no base span covers and that
only few owners hold.  Each candidate value is hashed; hashes are counted by distinct repositories and owners over the
whole corpus, which separates widely copied examples from owner-specific values.

Defined cases: null text is empty; rows are kept as they are, repeated ones too; a null owner or repository counts as
one owner or repository; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: kind, pattern, group that holds the value, least length of that group
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
               r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
ADDED = ("live", r"([A-Za-z0-9+/_]{24,})", 1, 24)
KINDS = (*BASE, ADDED)
#: A value held by this many owners is a copied example.
COPIED_OWNERS = 3


def find_spans(text: str, matches: str, values: str, pieces: str, order: int, least: int) -> Column:
    """Array of (start, ord, end, value): code points, end exclusive; matches whose value is too short are dropped."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("ord"), F.lit(0).alias("end"), F.lit("").alias("value"))
    zero = F.struct(F.lit(0).alias("at"), F.filter(F.array(span), lambda x: F.lit(False)).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["match"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.char_length(x["value"]) >= least, F.concat(
            acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("piece"), F.col(matches).alias("match"),
                          F.col(values).alias("value"))
    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def candidates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (columns key, owner, repository, text) with its spans of all kinds, unjudged.

    A row without any match of a pattern (most rows) pays one pass over its text for it.
    """
    df = docs
    for kind, pattern, group, _ in KINDS:
        hit = F.rlike("text", F.lit(pattern))
        df = df.withColumns({
            f"m_{kind}": F.when(hit, F.struct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("m"),
                                              F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("v"),
                                              F.split("text", pattern, -1).alias("p")))})
    cols = []
    for order, (kind, _, _, least) in enumerate(KINDS):
        s = f"m_{kind}"
        found = find_spans("text", f"{s}.m", f"{s}.v", f"{s}.p", order, least)
        cols.append(F.when(F.col(s).isNotNull(), found).alias(kind))
    df = df.select("key", "owner", "repository", *cols)
    nothing = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("ord"), F.lit(0).alias("end"),
                                        F.lit("").alias("value"))), lambda x: F.lit(False))
    base = F.concat(*[F.coalesce(k[0], nothing) for k in BASE])
    shaped = F.filter(F.coalesce(ADDED[0], nothing), lambda x: (
        F.rlike(x["value"], F.lit("[0-9].*[0-9].*[0-9]")) & F.rlike(x["value"], F.lit("[A-Z]"))
        & F.rlike(x["value"], F.lit("[a-z]"))))
    df = df.select("key", "owner", "repository", base.alias("base"), shaped.alias("shaped"))
    free = F.filter("shaped", lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return df.select("key", "owner", "repository", F.array_sort(F.concat("base", free)).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, repositories, owners, uses) over the corpus.  Both steps aggregate before they shuffle, so a value
    that a third of all rows hold is one row per owner, repository and task."""
    each = found.select("owner", "repository", F.explode("spans").alias("s")).select(
        "owner", "repository", F.sha2(F.col("s.value"), 256).alias("value_hash"))
    per = each.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = per.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("value_hash").agg(F.sum("repositories").alias("repositories"),
                                            F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("uses"))


def scan_secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row: key, and spans (start, ord, end, value, repositories, owners, live), sorted, base kinds always and kind
    ``live`` where the value is owner-specific.  ``docs`` has key (unique), owner, repository, text."""
    found = stored(candidates(docs.withColumn("text", F.coalesce("text", F.lit("")))), "secrets")
    hit = found.select("key", F.explode("spans").alias("s")).withColumn("value_hash", F.sha2(F.col("s.value"), 256))
    judged = hit.join(ownership(found), "value_hash").withColumn("live", F.col("owners") < copied_owners)
    judged = judged.where(F.col("live") | (F.col("s.ord") < len(BASE)))
    spans = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(
        "s.start", "s.ord", "s.end", "s.value", "repositories", "owners", "live"))).alias("spans"))
    return found.select("key").join(spans, "key", "left").withColumn("spans", F.coalesce("spans", F.expr(
        "array()").cast(spans.schema["spans"].dataType)))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with every live span's place taken by ``mark``; overlapping spans become one."""
    live = F.filter(spans, lambda s: s["live"])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out")))

    rest = F.aggregate(live, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    return F.when(F.size(live) > 0, rest).otherwise(text)
