"""Learned patterns: a dimension of (scope, bucket, tier, value, ...) matched against normalised lines with strict precedence."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from logsieve.functions import text as t
from logsieve.operators import substrings
from logsieve.sources.tables import cut

#: Verdict buckets and match tiers in the order in which they are tried.
BUCKETS = ["malicious", "alert", "allow", "suppress"]
TIERS = ["hash", "prefix", "regex", "contains"]
GLOBAL = "__global__"
SCHEMA = "scope string, bucket string, tier string, value string, source string, reason string, revoked boolean, ord long"
#: Most patterns of a bucket and scope, by tier; those of EXEMPT sources are taken beyond them.
EXEMPT = ["human", "human_validated", "seeded"]
CAPS = {"hash": 100_000, "prefix": 1000, "regex": 1000, "contains": 500}
#: Patterns of a scope up to which an array is as good as an automaton, and bytes of patterns up to which automata are broadcast.
FEW, AUTOMATA_BYTES = 64, 16 << 20
#: Dimensions are broadcast up to this many rows; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000

# Parts of a line that prove an attack, with their reasons.
SEEDS = [
    ("bash -i >& /dev/tcp", "Bash reverse shell"),
    ("nc -e /bin/sh", "Netcat reverse shell"),
    ("base64 -d | bash", "Encoded command execution"),
    ("curl | sh", "Remote code execution via curl pipe"),
    ("wget | sh", "Remote code execution via wget pipe"),
    ("rm -rf /", "Destructive filesystem command"),
    ("root:x:0:0:root", "System credential file contents (/etc/passwd) in output"),
    ("BEGIN RSA PRIVATE KEY", "RSA private key in output"),
    ("BEGIN OPENSSH PRIVATE KEY", "SSH private key in output"),
    ("BEGIN EC PRIVATE KEY", "EC private key in output"),
    ("BEGIN PRIVATE KEY", "Private key in output"),
]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def seeds() -> list[tuple]:
    """Rows of SCHEMA for the seeds."""
    return [(GLOBAL, "malicious", "contains", value, "seed", reason, False, i) for i, (value, reason) in enumerate(SEEDS)]


def patterns(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def _rank(names: list[str], c: str) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col(c))


def match(events: DataFrame, known: DataFrame, when: Column | None = None) -> DataFrame:
    """``events`` (scope, hash, normalized, ...) with ``match``: bucket, tier, value, source and reason of the first live pattern, null where none matches; with ``when``, only rows for which it holds are looked up.

    Order: bucket, then the event's own scope before the global one, then tier, then ord. The hash tier is an
    equi-join. Of the other tiers, bounded by CAPS, a scope of at most FEW patterns travels as one sorted array
    joined by scope. Scopes of more are searched by automata (``_Automata``), so that a line costs its length and not
    the number of patterns; they are broadcast, if their patterns take at most AUTOMATA_BYTES (summed up), else
    lines and patterns are joined by the texts that patterns must hold (``_joined``). Either way gives the same
    pattern. Values of the regex tier have RE2's meaning.
    """
    p = F.struct(
        _rank(BUCKETS, "bucket").alias("bucket_rank"), (F.col("scope") == GLOBAL).cast("int").alias("scope_rank"), _rank(TIERS, "tier").alias("tier_rank"),
        "ord", "bucket", "tier", "value", "source", "reason", "java",
    )
    live = _with_java(known.where(~F.coalesce("revoked", F.lit(False)))).select("scope", p.alias("p"))
    hashes = live.where("p.tier = 'hash'").groupBy("scope", F.col("p.value").alias("hash")).agg(F.min("p").alias("p"))
    rest = live.where("p.tier <> 'hash'")
    sizes = rest.groupBy("scope").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("p.value"), F.lit(0)).cast("long") + 100).alias("bytes"))
    many = sizes.where(F.col("n") > FEW)
    size = many.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.coalesce(F.bool_or(F.col("scope") == GLOBAL), F.lit(False)).alias("everywhere")).first()
    automata, joined = None, size.bytes is not None and size.bytes > AUTOMATA_BYTES
    if joined:
        events, rest = _joined(events, rest, many.select("scope"), size, when)
    arrays = rest.groupBy("scope").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    if size.n and not joined:
        automata = _Automata({r.scope: [tuple(x) for x in r.ps] for r in arrays.where(F.size("ps") > FEW).collect()})
        arrays = arrays.where(F.size("ps") <= FEW)
    own, everywhere = F.col("scope") != GLOBAL, F.col("scope") == GLOBAL
    out = events.withColumn("_global", F.lit(GLOBAL))
    out = out.join(small(hashes.where(own).withColumnRenamed("p", "_h")), ["scope", "hash"], "left")
    out = out.join(small(hashes.where(everywhere).select("hash", F.col("p").alias("_g"))), "hash", "left")
    out = out.join(small(arrays.where(own).withColumnRenamed("ps", "_hs")), "scope", "left")
    out = out.join(F.broadcast(arrays.where(everywhere).select(F.col("scope").alias("_global"), F.col("ps").alias("_gs"))), "_global", "left")  # one row
    n = F.col("normalized")
    first = lambda ps: _first(n, ps)
    parts = [F.col("_h"), F.col("_g"), first("_hs"), first("_gs")]
    if automata:
        out = out.withColumn("_auto", automata.searched(live.sparkSession, live.schema["p"].dataType)(F.col("scope"), n if when is None else F.when(when, n)))
        parts += [F.col("_auto.first"), first(F.col("_auto.maybe"))]
    if joined:
        parts.append(F.col("_joined"))
    best = F.least(*parts)
    out = out.withColumn("_best", best if when is None else F.when(when, best))
    found = F.when(F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{c}").alias(c) for c in ("bucket", "tier", "value", "source", "reason")]))
    return out.withColumn("match", found).drop("_h", "_g", "_hs", "_gs", "_global", "_best", "_auto", "_joined", "_line_id")


def _first(n: Column, ps: Column) -> Column:
    """The first of an array of patterns, of other tiers than hash, that matches."""
    hit = lambda x: F.when(x["tier"] == "prefix", F.startswith(n, x["value"])).when(x["tier"] == "contains", F.contains(n, x["value"])).otherwise(F.regexp_like(n, x["java"]))
    return F.get(F.filter(ps, hit), F.lit(0))


def _joined(events: DataFrame, rest: DataFrame, many: DataFrame, size: Row, when: Column | None) -> tuple[DataFrame, DataFrame]:
    """``events``, cut, with ``_joined``: the first matching pattern of ``rest`` (scope, p) in scopes of ``many`` that has a text which lines must hold; and those of ``rest`` that remain to be tried.

    Such texts are the values of the prefix and contains tiers and ``literal`` of a regex. Lines and patterns meet by
    scope and text, and a regex is tried where its text is found. What remains are the patterns of other scopes and
    those without a text: of empty values only the first of a tier, and regexes, which are tried on every line of
    their scope.
    """
    n = F.col("normalized") if when is None else F.when(when, F.col("normalized"))
    events = cut(events.withColumns({"_line_id": F.monotonically_increasing_id(), "_line_text": n.cast("binary")}), "lines")
    many = small(cut(many, "scopes"))
    held = rest.join(many, "scope", "left_semi")
    regexes = held.where("p.tier = 'regex'").withColumn("word", _literal("p.value")).withColumn("start", F.startswith(F.col("p.value"), F.lit("^")))
    values = held.where("p.tier <> 'regex'").withColumns({"word": F.col("p.value"), "start": F.col("p.tier") == "prefix"})
    always = values.where("word = ''").groupBy("scope", "start").agg(F.min("p").alias("p"))
    left = rest.join(many, "scope", "left_anti").unionByName(always.select("scope", "p")).unionByName(regexes.where("word = ''").select("scope", "p"))

    lines = events.where("_line_text IS NOT NULL").select(F.col("_line_id").alias("_id"), "scope", F.col("_line_text").alias("text"))
    if not size.everywhere:
        lines = lines.join(many, "scope", "left_semi")
    by = ["scope", "start", "key"]
    keyed = lambda words, **first: words.where("word <> ''").groupBy("scope", "start", F.col("word").cast("binary").alias("key")).agg(*[c.alias(k) for k, c in first.items()])
    # what a line holds counts for its own scope and for all
    meet = lambda found: found.withColumn("scope", F.explode(F.array("scope", F.lit(GLOBAL)))) if size.everywhere else found
    values, regexes = keyed(values, p=F.min("p")), keyed(regexes, ps=F.sort_array(F.collect_list("p")))
    out = meet(substrings.found(lines, values, size.n)).join(values, by).select("_id", "p")
    if count := regexes.count():
        tried = meet(substrings.found(lines, regexes, count, whole=True)).join(small(regexes), by)
        out = out.unionByName(tried.select("_id", _first(F.col("text").cast("string"), F.col("ps")).alias("p")).where("p IS NOT NULL"))
    best = out.groupBy(F.col("_id").alias("_line_id")).agg(F.min("p").alias("_joined"))
    return events.drop("_line_text").join(best, "_line_id", "left"), left


@F.pandas_udf(StringType())
def _literal(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else literal(v))


@F.pandas_udf(StringType())
def _java(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else t.java(v))


def _with_java(known: DataFrame) -> DataFrame:
    """``known`` with ``java``: what a value of the regex tier is for Spark. Values on which both agree need no translation, and mostly all are such."""
    regex = F.when(F.col("tier") == "regex", F.col("value"))
    odd = known.where(regex.rlike(r"\\[sSb]|[.$]|\(\?i")).limit(1).count()
    return known.withColumn("java", _java(regex) if odd else regex)


def literal(regex: str) -> str:
    """A text that every match of an RE2 pattern begins with or holds; empty where none is sure."""
    body = regex[1:] if regex.startswith("^") else regex
    if "|" in body or "(?" in body:
        return ""
    run = re.match(r"[0-9A-Za-z _/<>:%,;=@~'\"#&!-]*", body)[0]
    # what a quantifier follows may be missing
    return run[:-1] if body[len(run) : len(run) + 1] in ("*", "?", "+", "{") and run else run


class _Automata:
    """Of each scope one Aho-Corasick automaton over all values of its prefix and contains tiers, and over a text that each of its regexes must hold.

    A value that ends somewhere in a line is in it; it is its prefix if it begins at its start. The best of those found,
    by precedence, is the first match of these tiers. Regexes whose text is found, and those without one, are handed
    on for Spark to try. The automata of a scope are built by a worker when its first line comes.
    """

    def __init__(self, scopes: dict[str, list[tuple]]):
        self.scopes, self.built = scopes, {}

    def __getstate__(self):
        return {"scopes": self.scopes, "built": {}}

    def of(self, scope: str):
        if scope not in self.built:
            patterns = self.scopes.get(scope, [])
            words: dict[str, list] = {}
            always, free = len(patterns), []
            for i, p in enumerate(patterns):  # in order of precedence; places: as prefix, as part, and regexes
                tier, value = p[5], p[6]
                if value is None:
                    continue
                key = literal(value) if tier == "regex" else value
                if not key:
                    if tier == "regex":
                        free.append(i)
                    else:
                        always = min(always, i)
                    continue
                at = words.setdefault(key, [len(patterns), len(patterns), []])
                if tier == "regex":
                    at[2].append(i)
                else:
                    at[tier == "contains"] = min(at[tier == "contains"], i)
            tree = ahocorasick.Automaton()
            for word, at in words.items():
                tree.add_word(word, (len(word), *at))
            tree.make_automaton()
            self.built[scope] = (patterns, tree if words else None, always, free)
        return self.built[scope]

    def search(self, scope: str, line: str) -> tuple[tuple | None, list[tuple]]:
        """The first pattern of the literal tiers, and the regexes before it that are to be tried."""
        patterns, tree, best, free = self.of(scope)
        maybe = list(free)
        for end, (size, prefix, part, regexes) in tree.iter(line) if tree else ():
            best = min(best, part, prefix if end + 1 == size else best)
            maybe += regexes
        return patterns[best] if best < len(patterns) else None, [patterns[i] for i in sorted(set(maybe)) if i < best]

    def searched(self, spark: SparkSession, kind: StructType):
        shared = spark.sparkContext.broadcast(self)
        names = kind.names

        @F.pandas_udf(StructType([StructField("first", kind), StructField("maybe", ArrayType(kind))]))
        def run(scopes: pd.Series, lines: pd.Series) -> pd.DataFrame:
            automata = shared.value
            memo: dict[tuple, tuple] = {}
            out = []
            for key in zip(scopes, lines, strict=True):
                if key not in memo:
                    found = [automata.search(s, key[1]) for s in (key[0], GLOBAL) if s in automata.scopes and key[1] is not None]
                    first = min((f for f, _ in found if f), key=lambda f: f[:4], default=None)
                    maybe = sorted((p for _, m in found for p in m), key=lambda f: f[:4])
                    memo[key] = (first and dict(zip(names, first, strict=True)), [dict(zip(names, p, strict=True)) for p in maybe])
                out.append(memo[key])
            return pd.DataFrame({"first": pd.Series([o[0] for o in out], dtype=object), "maybe": pd.Series([o[1] for o in out], dtype=object)})

        return run


def learn(known: DataFrame, new: DataFrame, caps: dict[str, int] | None = CAPS) -> DataFrame:
    """``known`` and those rows of ``new`` (same columns) that repeat no live value of their scope, bucket and tier and fit under ``caps``; rows of EXEMPT sources always fit.

    A bucket is as full as it has rows, of whatever source, revoked ones too. Without ``caps`` every new value is
    learned; nothing is put in order then, so that a bucket of any size stays spread.
    """
    key = ["scope", "bucket", "tier", "value"]
    live = known.where(~F.coalesce("revoked", F.lit(False)))
    fresh = new.groupBy(*key).agg(F.min_by(F.struct("source", "reason", "revoked", "ord"), "ord").alias("r")).select(*key, "r.*").join(live.select(*key).distinct(), key, "left_anti")
    if caps is None:
        return known.unionByName(fresh.select(*known.columns))
    held = known.groupBy(*key[:3]).agg(F.count("*").alias("_held"))
    cap = F.coalesce(*[F.when(F.col("tier") == t, n) for t, n in caps.items()])
    # new rows take their places in order, those of exempt sources too
    order = Window.partitionBy(*key[:3]).orderBy("ord", "value")
    placed = fresh.withColumn("_n", F.row_number().over(order)).join(held, key[:3], "left")
    fits = F.col("source").isin(EXEMPT) | (F.col("_n") + F.coalesce("_held", F.lit(0)) <= cap)
    return known.unionByName(placed.where(fits).select(*known.columns))


# Prefixes that say nothing once placeholders and spaces are gone; case does not count.
GENERIC_PREFIXES = [
    "ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE", "NOTICE", "FATAL",
    "GET /", "POST /", "PUT /", "DELETE /", "HEAD /", "PATCH /", "OPTIONS /", "panic:",
]
# Regular expressions that match everything.
BROAD = [".*", ".+", "^.*$"]
#: What a regular expression may not hold, as the engines that run it differ on it.
_APART = re.compile(r"\(\?(?![:i])|[*+?}]\+|\[\[|&&|\\[zZGAQEpPkKRXhHvVuUxN0-9]")


@F.pandas_udf(StringType())
def _regex_fault(values: pd.Series, lines: pd.Series) -> pd.Series:
    """Why a regular expression cannot be taken; null where it can."""

    def fault(value, line):
        if value is None:
            return None
        try:
            found = re.compile(value)
        except (re.error, RecursionError, OverflowError):
            return "regex does not compile"
        if _APART.search(value):
            return "regex uses syntax that engines read differently"
        return None if not line or found.search(line) else "regex does not match the original line it was generated from"

    return pd.Series([fault(v, x) for v, x in zip(values, lines, strict=True)], dtype=object)


def faults(new: DataFrame) -> DataFrame:
    """``new`` (tier, value, source, original_line) with ``fault``: why a pattern cannot be learned; null where it can.

    Sources of people are trusted more than a model: they may give shorter prefixes, and parts of lines at all.
    """
    human, size, line = F.col("source").isin(EXEMPT), F.octet_length("value"), F.coalesce("original_line", F.lit(""))
    out = new.withColumn("_regex", _regex_fault(F.when(F.col("tier") == "regex", F.col("value")), line))
    bare = F.lower(F.regexp_replace(F.regexp_replace("value", "<[^>]*>", ""), f"[{t.BLANKS}]+", ""))
    generic = bare.isin(sorted({g.lower().replace(" ", "") for g in GENERIC_PREFIXES}))
    short = F.when(human, 5).otherwise(20)
    value = F.col("value")
    prefix = (
        F.when(size < short, F.format_string("prefix too short (%d chars), minimum %d", size, short)).when(~human & (line != "") & ~F.startswith(line, value), "auto-learned prefix does not literally prefix the original line")
        .when(~human & generic, "auto-learned prefix is structurally just a generic token")
    )
    regex = (
        F.when(F.col("_regex").isNotNull(), F.col("_regex")).when(value.isin(BROAD), "regex is too broad").when(~human & ~value.startswith("^"), "auto-learned regex must be anchored with ^")
        .when(~human & value.startswith("^.*"), "auto-learned regex begins with ^.*").when(~human & (size < 10), "auto-learned regex too short")
    )
    contains = F.when(~human, "auto-learned contains patterns are forbidden").when(size < 10, "contains pattern too short")
    by_tier = F.when(F.col("tier") == "hash", F.when(size != 64, "hash must be 64 hex characters")).when(F.col("tier") == "prefix", prefix).when(F.col("tier") == "regex", regex).when(F.col("tier") == "contains", contains).otherwise("unknown pattern type")
    return out.withColumn("fault", by_tier).drop("_regex")


def revoke(known: DataFrame, gone: DataFrame) -> DataFrame:
    """``known`` with the patterns of ``gone`` (scope, bucket, value) revoked; they stay in the table."""
    return _marked(known, gone, {"revoked": F.lit(True)})


def delete(known: DataFrame, gone: DataFrame) -> DataFrame:
    """``known`` without the patterns of ``gone`` (scope, bucket, value)."""
    return known.join(small(gone.select("scope", "bucket", "value").distinct()), ["scope", "bucket", "value"], "left_anti").select(*known.columns)


def validate(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``known`` with the patterns of ``seen`` (scope, bucket or null for any, value) marked as validated by a person."""
    any_bucket = seen.where("bucket IS NULL").select("scope", "value").join(known.select("scope", "bucket", "value").distinct(), ["scope", "value"])
    return _marked(known, seen.where("bucket IS NOT NULL").select("scope", "bucket", "value").unionByName(any_bucket.select("scope", "bucket", "value")), {"source": F.lit("human_validated")})


def _marked(known: DataFrame, rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    hit = rows.select("scope", "bucket", "value").distinct().withColumn("_hit", F.lit(True))
    out = known.join(small(hit), ["scope", "bucket", "value"], "left")
    return out.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in known.columns])


def counts(known: DataFrame) -> DataFrame:
    """Live patterns of each scope by bucket."""
    live = known.where(~F.coalesce("revoked", F.lit(False)))
    return live.groupBy("scope").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
