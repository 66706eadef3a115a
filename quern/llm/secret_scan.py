"""Secret scans with multipart credential linking, in DataFrame functions alone.

Three kinds of spans are reported wherever they match (the base): assignments of a secret, access
identifiers and long hexadecimal runs. Weak candidates alone mean little: bare access identifiers,
bare secrets and endpoints. They are reported only where complementary parts (an identifier and
a secret, a secret and an endpoint) lie within one scope, ``SCOPE`` code points of each other, or
where a secret lies in the user-info or query part of an endpoint.

All of it happens within a row, so nothing is shuffled and no group of rows can grow. Positions
come from splitting a text by the pattern and adding up the lengths of pieces and matches. The
interval join sorts a text's parts by start and meets each one only with neighbours that can reach
it: parts of one kind don't overlap and have a least length, so a scope holds a bounded number.

Defined cases: a null text has no spans; spans count code points, ends exclusive; equal starts
order by kind as listed; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 400
#: The base kinds, in the order in which equal starts are listed. An assignment's group 2 has to have 8 characters or more.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As maximal runs, a least length says the same as dropping short matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts: kind, complementary role, pattern, least length.
WEAK = (
    ("weak_identifier", "identifier", r"(?<![A-Za-z0-9_])(?=[A-Z0-9]{0,31}[0-9])[A-Z][A-Z0-9]{15,31}(?![A-Za-z0-9_])", 16),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])", 20),
    ("weak_endpoint", "endpoint", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", 8),
)
KINDS = ("assign", "access", "hex", *(w[0] for w in WEAK))
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {w[0]: w[1] for w in WEAK}
_LEAST = {"assign": 14, "access": 16, "hex": 32} | {w[0]: w[3] for w in WEAK}
BLOCK = 128  #: matches whose positions are added up in one array


def _ranges(lengths: Column) -> Column:
    """Starts and ends of the m parts of (p, m) lengths that follow each other.

    Appending to an array copies it, so ranges are made for ``BLOCK`` lengths at a time and then moved by where their block
    starts: the cost of a text is in proportion to its matches.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")

    def appended(a: Column, x: Column) -> Column:
        span = F.struct((a["at"] + x["p"]).alias("start"), (a["at"] + x["p"] + x["m"]).alias("end"))
        return F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    one = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("spans")), appended)
    blocks = F.transform(F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK)), lambda low: one(F.slice(lengths, low, BLOCK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
    bases = lambda found: F.aggregate(found, start, lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["bases"], F.array(a["at"])).alias("bases")), lambda a: a["bases"])
    moved = lambda x, base: F.transform(x["spans"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end")))
    many = F.transform(F.array(blocks), lambda found: F.flatten(F.zip_with(found, bases(found), moved)))[0]  # an array of one binds the blocks
    return F.when(F.size(lengths) <= BLOCK, one(lengths)["spans"]).otherwise(many)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """The leftmost non-overlapping matches as sorted structs (start, rank of kind, kind, end, match)."""
    pieces, matches, rank = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), KINDS.index(kind)
    lengths = F.zip_with(F.transform(pieces, F.length), F.transform(matches, F.length), lambda p, m: F.struct(p.alias("p"), F.coalesce(m, F.lit(0)).alias("m")))
    named = lambda s, m: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), m.alias("match"))
    # arrays of one bind what is used more than once; the piece after the last match has none
    both = F.transform(F.array(F.struct(lengths.alias("lengths"), matches.alias("matches"))), lambda x: F.zip_with(F.slice(_ranges(x["lengths"]), F.lit(1), F.size(x["matches"])), x["matches"], named))
    return both[0]


def _found(text: Column, pattern: str, kind: str, hint: str | None = None) -> Column:
    """``_spans`` where a cheap test says that there may be any."""
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,match:string>>")
    return F.when(text.rlike(hint or pattern), _spans(text, pattern, kind)).otherwise(empty)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """A row for each row: id, base and spans, both arrays of (start, rank, kind, end, match) in order; spans has base and linked weak parts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", text.alias("text"))
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], "^" + ASSIGN, 2)) >= 8
    found = rows.select(
        "id",
        F.filter(_found(F.col("text"), ASSIGN, "assign"), long_enough).alias("assign"),
        _found(F.col("text"), ACCESS, "access").alias("access"),
        _found(F.col("text"), HEX, "hex").alias("hex"),
        *[_found(F.col("text"), pattern, kind).alias(kind) for kind, _, pattern, _ in WEAK],
    )
    found = found.select("id", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.array_sort(F.concat(*KINDS)).alias("parts"))
    role = F.create_map(*[F.lit(x) for pair in _ROLE.items() for x in pair])
    reach = sum(math.ceil(scope / n) + 2 for n in _LEAST.values())

    def inside(url: Column, secret: Column) -> Column:
        """Whether a part lies in the user-info or the query of an endpoint."""
        held = (url["kind"] == "weak_endpoint") & (secret["start"] >= url["start"]) & (secret["start"] < url["end"])
        users = F.length(F.regexp_extract(url["match"], r"^[a-z]+://[^?#]*@", 0))
        return held & ((secret["end"] - url["start"] <= users) | F.substring(url["match"], F.lit(1), secret["start"] - url["start"]).contains("?"))

    def linked(x: Column, i: Column) -> Column:
        near = F.slice("parts", F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
        joins = lambda a, b: (a.isin("identifier", "endpoint") & (b == "secret")) | ((a == "secret") & b.isin("identifier", "endpoint"))
        apart = lambda y: F.greatest(y["start"] - x["end"], x["start"] - y["end"])
        return (x["rank"] < 3) | F.exists(near, lambda y: joins(role[x["kind"]], role[y["kind"]]) & (apart(y).between(0, scope) | inside(x, y) | inside(y, x)))

    weak = F.exists("parts", lambda x: x["rank"] >= 3)
    return found.select("id", "base", F.when(weak, F.filter("parts", linked)).otherwise(F.col("base")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
