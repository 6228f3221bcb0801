"""Secret scans with linking of parts that only count together.

Certain finds are reported as they are. Weak candidates, which are an identifier, a
bare key or an endpoint, are reported only where complementary parts stand nearby:
an interval join within the paragraph of a document. Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import among, keyed, let, row_id, without
from tillbook.operators.staging import staged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs of hex digits are greedy and those of AKIA too, so that asking for the least
# length in the pattern finds what dropping short matches would leave.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak candidates. Identifiers may end a longer name, as in DB_USER; keys may follow a "=".
IDENTIFIER = r"""(?i)(?<![\p{L}\p{N}])(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
# Each look ahead passes over what is not yet the wanted sort of character, once, however long.
KEY = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?i)\b(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh|s3)://[^\x00-\x20\"'<>]{4,}"

BASE_KINDS = ["assign", "access", "hex"]
WEAK_KINDS = ["identifier", "key", "endpoint"]
# Roles that must stand near a weak candidate: all those listed.
NEEDS = {"identifier": ["secret"], "key": ["identifier"], "endpoint": ["identifier", "secret"]}
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
# Parts are near if their starts are at most this many characters apart.
REACH = 240
# Elements whose running sums are added up at a time.
RUN = 128

SPAN = "struct<start: bigint, kind: int, end: bigint>"


def running(sizes: Column) -> Column:
    """Sums of the elements before each element, in two levels, so that long arrays
    cost about RUN steps per element."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda r: total(F.slice(sizes, r * RUN + 1, RUN)))
    bases = F.aggregate(runs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def sums(base: Column) -> Column:
        return F.transform(
            sizes,
            lambda _, i: F.get(base, F.floor(i / RUN).cast("int")) + total(F.slice(sizes, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)),
        )

    return let(bases, sums)


def spans(text: Column, pattern: str, kind: Column, value: Column | None = None, least: int = 0) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` as ``start, kind, end`` in code points.

    The text between matches and the matches follow each other in turn, so that starts
    are running sums of their lengths. ``value`` is the group whose length must be at
    least ``least``.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def placed(hits: Column) -> Column:
        between = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), lambda x: F.char_length(x).cast("long"))
        lengths = F.transform(hits, lambda x: F.char_length(x).cast("long"))
        both = F.arrays_zip(between.alias("gap"), lengths.alias("own"))
        starts = lambda parts: let(running(F.transform(parts, lambda p: p["gap"] + p["own"])), lambda sums: F.zip_with(sums, parts, start_end))

        def start_end(before: Column, part: Column) -> Column:
            return F.struct((before + part["gap"]).alias("start"), kind.cast("int").alias("kind"), (before + part["gap"] + part["own"]).alias("end"))

        return let(both, starts)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if value is None:
        return let(found, lambda hits: F.when(F.size(hits) > 0, placed(hits)).otherwise(none))
    long_enough = lambda hits: F.transform(F.regexp_extract_all(text, F.lit(pattern), value), lambda v: F.char_length(v) >= least)
    kept = lambda hits: let(F.zip_with(placed(hits), long_enough(hits), lambda s, ok: F.struct(s.alias("s"), ok.alias("ok"))), lambda x: F.transform(F.filter(x, lambda y: y["ok"]), lambda y: y["s"]))  # noqa: E731, E501
    return let(found, lambda hits: F.when(F.size(hits) > 0, kept(hits)).otherwise(none))


def parts(docs: DataFrame) -> DataFrame:
    """``id, fp, doc_id, base, weak, breaks``: spans of certain and of weak parts and of blank lines.

    Weak parts that overlap a certain one are left out. The only pass over the texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(
        spans(text, ASSIGN, F.lit(0), F.lit(2), 6),
        spans(text, ACCESS, F.lit(1)),
        spans(text, HEX, F.lit(2)),
    )
    weak = F.concat(*[spans(text, pattern, F.lit(3 + i)) for i, pattern in enumerate((IDENTIFIER, KEY, ENDPOINT))])
    found = docs.select(row_id(docs).alias("id"), F.xxhash64("text").alias("fp"), "doc_id", base.alias("base"), weak.alias("weak"), text.alias("text"))
    any_part = (F.size("base") > 0) | (F.size("weak") > 0)
    blank = F.when(any_part & (F.size("weak") > 0), spans(F.col("text"), r"\n[\x20\t\r]*\n\s*", F.lit(-1))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return found.select("id", "fp", "doc_id", F.sort_array("base").alias("base"), "weak", blank.alias("breaks"))


def linked(found: DataFrame) -> DataFrame:
    """``id, fp, linked``: the weak parts, per document, that have their complements nearby.

    Parts carry their paragraph and a bucket of REACH characters; a complement lies in
    the same bucket or a neighbouring one. The joins are semi joins on document,
    paragraph, role and bucket, so that no pair is ever emitted, and a bucket holds at
    most as many parts as fit in it. A key that is the value of an identifier is no
    complement of it; an endpoint may hold its own.
    """
    rich = found.filter("size(weak) > 0").dropDuplicates(["id", "fp"])
    # Paragraph breaks take part in the order as kind -1; their running count is the paragraph.
    merged = F.concat("base", "weak", "breaks")
    items = rich.select("id", "fp", F.posexplode(F.sort_array(merged)).alias("i", "s"))
    items = staged(items.select("id", "fp", "i", "s.start", "s.kind", "s.end"), "secret-parts")
    breaks = items.filter("kind = -1").groupBy("id", "fp").agg(F.sort_array(F.collect_list("start")).alias("breaks"))
    placed = items.filter("kind >= 0").join(breaks, ["id", "fp"], "left")
    scope = F.coalesce(F.size(F.filter("breaks", lambda b: b < F.col("start"))), F.lit(0))
    names = F.array(*[F.lit(k) for k in BASE_KINDS + WEAK_KINDS])
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    placed = placed.select("id", "fp", "start", "kind", "end", scope.alias("scope"), F.get(names, "kind").alias("name"))
    placed = staged(placed.withColumn("role", role[F.col("name")]), "secret-scopes")
    other = placed.select(
        F.col("id").alias("id2"), F.col("fp").alias("fp2"), F.col("scope").alias("scope2"), F.col("role").alias("role2"),
        F.col("start").alias("start2"), F.col("end").alias("end2"), F.floor(F.col("start") / REACH).alias("bucket2"),
    )
    overlap = placed.filter("kind >= 3").select("id", "fp", "start", "kind", "end", "scope", "name")
    certain = placed.filter("kind < 3").select("id", "fp", F.col("start").alias("s0"), F.col("end").alias("e0"))
    overlap = overlap.join(certain, (overlap["id"] == certain["id"]) & (overlap["fp"] == certain["fp"]) & (F.col("start") < F.col("e0")) & (F.col("s0") < F.col("end")), "left_anti")
    out = None
    for name, needs in NEEDS.items():
        weak = overlap.filter(F.col("name") == name)
        apart = F.lit(True) if name == "endpoint" else (F.col("end2") <= F.col("start")) | (F.col("start2") >= F.col("end"))
        for need in needs:
            bucket = F.floor(F.col("start") / REACH)
            near = weak.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
            side = other.filter(F.col("role2") == need)
            near = near.join(
                side,
                (F.col("id") == F.col("id2")) & (F.col("fp") == F.col("fp2")) & (F.col("scope") == F.col("scope2")) & (F.col("bucket") == F.col("bucket2"))
                & (F.abs(F.col("start") - F.col("start2")) <= REACH) & apart,
                "left_semi",
            )
            weak = near.drop("bucket").distinct()
        out = weak if out is None else out.unionByName(weak)
    spans_of = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    return out.groupBy("id", "fp").agg(spans_of.cast(f"array<{SPAN}>").alias("linked"))


def scanned(docs: DataFrame) -> DataFrame:
    """``id, fp, doc_id, base, spans`` of every row; ``spans`` are base and linked ones, in order.

    NULL and empty texts have none; equal rows have equal spans; positions are code
    points, ends exclusive; an empty table gives none.
    """
    found = staged(parts(docs), "secret-finds")
    more = staged(linked(found), "secret-links")
    joined = found.join(more, ["id", "fp"], "left")
    every = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))))
    return joined.select("id", "fp", "doc_id", "base", every.alias("spans"))


def listed(found: str) -> Column:
    names = F.array(*[F.lit(k) for k in BASE_KINDS + WEAK_KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned(docs).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``n_chars``, if there, follows the text.

    Overlapping spans are replaced once. Rows without spans stay as they are.
    """
    apart = F.aggregate(
        "spans",
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = scanned(docs).filter("size(spans) > 0").select("id", "fp", apart.alias("spans")).dropDuplicates(["id", "fp"])
    found = staged(found, "secret-spans")
    text = F.col("row.text")

    def rebuilt(at: Column) -> Column:
        # What stands before each span, marked, and what follows the last.
        begin = lambda i: F.coalesce(F.get(at, i - 1)["end"], F.lit(0))
        pieces = F.transform(at, lambda s, i: F.concat(F.substring(text, (begin(i) + 1).cast("int"), (s["start"] - begin(i)).cast("int")), F.lit(mark)))
        rest = F.substring(text, (F.element_at(at, -1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
        return F.concat(F.array_join(pieces, ""), rest)

    changed = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    columns = [changed[c].alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    blanked = among(keyed(docs), found).withColumn("new", let(F.col("spans"), rebuilt)).select(*columns)
    return without(keyed(docs), found).select("row.*").unionByName(blanked)
