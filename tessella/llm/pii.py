r"""Personal data by bootstrapped contextual extraction, in DataFrame operations.

Four base patterns (mail addresses, IP addresses, card numbers, phone numbers),
each with its check, find the seeds. The words next to a seed give lexical
patterns: the word before it or after it, two words on either side, the words on
both sides, and the word before it with the seed's shape. A looser pattern finds
candidates, things shaped like personal data that no base pattern takes: digit
groups without a plus sign or a valid check digit, addresses spelled with "at".
Candidates have words next to them as well, so patterns and instances (the
entities' texts) form a graph whose edges count occurrences.

The graph is scored in rounds. A pattern's score for a kind is the share of its
occurrences whose instances are known to be of that kind, shrunk towards zero
by ``PRIOR`` unknown occurrences. An instance's score is the best pattern it
occurs with; seeds keep score one. Candidates of patterns that score at
least ``CONFIDENT`` and have at least ``SUPPORT`` different instances are taken as spans, and as
instances of the next round's patterns. Known instances and good patterns only
grow, and the rounds end when no pattern has become good. Base spans always stay.

Matches are found by setting a mark around each, splitting at the marks, and
adding up lengths, in blocks of pieces; regular expressions start only where a
run of their first characters starts or the last match ended. Which candidates
touch base spans is told by one sort of both. So no text costs quadratic time.

Cases: null counts as the empty text and has no spans; the mark, U+E000, counts
as U+E001 where a text has it, and positions stay; repeated rows are scanned
alike and each counts in the graph; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cuts, cut

KINDS = ("email", "ip", "card", "phone")
MARK, OTHER = "\ue000", "\ue001"
PRIOR, CONFIDENT, SUPPORT = 2.0, 0.8, 5
#: Characters next to a match in which its neighbour words are looked for.
NEAR = 64
#: Pieces whose lengths are added up together; a fold that appends to an array copies it each time.
BLOCK = 128

_SPACE = r"\x20\x09-\x0D"
#: Where a match of a run of these characters can start.
_EDGE = r"(?:(?<![{0}])|\G)"
_LOCAL = r"A-Za-z0-9._%+-"
BASE = {
    "email": _EDGE.format(_LOCAL) + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _EDGE.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": _EDGE.format("0-9") + r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
_NEEDS = {"email": "@", "phone": "+"}
CANDIDATE = (
    _EDGE.format("0-9+") + r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
    r"|" + _EDGE.format(_LOCAL) + rf"[{_LOCAL}]++(?:\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"
)
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _pieces(text: Column, pattern: str) -> Column:
    """The text split at its matches: what stands before the first, the first, what follows, and so on."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    each = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(each(i))).otherwise(each(i)))
    return F.length(digits).between(12, 19) & (F.when(F.length(digits).between(12, 19), total % 10).otherwise(1) == 0)


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(9, 15),
}


def _word(near: Column, pattern: str, group: int = 1) -> Column:
    """The neighbour word that a pattern's group catches, lower-cased and bare of marks; null if there is none."""
    word = F.regexp_replace(F.lower(F.regexp_extract(near, pattern, group)), r"[^\p{L}\p{N}]+", "")
    return F.when(word != "", word)


_LEFT, _RIGHT = rf"([^{_SPACE}]+)[{_SPACE}(\[\"':]*$", rf"^[{_SPACE})\]\"'.,;:!?]*([^{_SPACE}]+)"


def _spans(pieces: Column, kind: Column) -> Column:
    """Matches as structs: start, end, kind, what was matched, and the words before and after."""
    # ends[i] is where piece i ends: within its block, plus where the block starts
    append = lambda a, n: F.struct((a.at + n).alias("at"), F.concat(a.ends, F.array(a.at + n)).alias("ends"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    blocks = F.transform(F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK)), lambda k: F.aggregate(F.slice(pieces, k, BLOCK), none, lambda a, p: append(a, F.length(p))))
    placed = lambda found, tops: F.flatten(F.transform(found, lambda x, k: F.transform(x.ends, lambda e: e + F.when(k > 0, F.get(tops, k - 1)).otherwise(0))))
    tops = lambda found: F.aggregate(found, none, lambda a, x: append(a, x.at), lambda a: a.ends)
    # each transform binds what it is of to a name, so that it is computed once
    ends = F.transform(F.transform(F.array(blocks), lambda x: F.struct(x.alias("found"), tops(x).alias("tops"))), lambda y: placed(y.found, y.tops))[0]
    odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    before = lambda i: F.right(F.get(pieces, i - 1), F.lit(NEAR))
    after = lambda i: F.left(F.get(pieces, i + 1), F.lit(NEAR))
    found = F.transform(
        F.array(ends),
        lambda e: F.transform(
            odd,
            lambda i: F.struct(
                F.get(e, i - 1).alias("start"),
                F.get(e, i).alias("end"),
                kind.alias("kind"),
                F.get(pieces, i).alias("match"),
                _word(before(i), rf"(?:^|[{_SPACE}]){_LEFT}").alias("left"),
                _word(after(i), _RIGHT).alias("right"),
                _word(before(i), rf"(?:^|[{_SPACE}])([^{_SPACE}]+)[{_SPACE}]+{_LEFT}").alias("left2"),
                _word(after(i), rf"{_RIGHT}[{_SPACE}]+([^{_SPACE}]+)", 2).alias("right2"),
            ),
        ),
    )[0]
    return F.when(F.size(pieces) > 2, found).otherwise(F.array().cast(_SPAN))


_SPAN = "array<struct<start:int,end:int,kind:int,match:string,left:string,right:string,left2:string,right2:string>>"


def _base(text: Column) -> Column:
    """All base spans, by start and then kind."""

    def of_kind(k: int, kind: str) -> Column:
        needs = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike("[0-9]")
        # the transform binds the pieces to a name, so that they are computed once
        spans = F.transform(F.array(_pieces(text, BASE[kind])), lambda p: _spans(p, F.lit(k)))[0]
        return F.when(needs, F.filter(spans, lambda s: _VALID[kind](s.match))).otherwise(F.array().cast(_SPAN))

    found = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.kind - b.kind))


def _candidates(text: Column) -> Column:
    """Loose matches; their kind is open."""
    spans = F.transform(F.array(_pieces(text, CANDIDATE)), lambda p: _spans(p, F.lit(-1)))[0]
    return F.when(text.rlike("[0-9@]|at[\\])]"), spans).otherwise(F.array().cast(_SPAN))


def _free(rows: DataFrame) -> DataFrame:
    """``row, s``: the loose matches that touch no base span, by one sort of both for each text that has both."""
    each = rows.filter(F.size("loose") > 0).select("row", F.explode(F.concat("base", "loose")).alias("s"))
    by_start = Window.partitionBy("row").orderBy("s.start")
    seed = F.col("s.kind") >= 0
    before = F.max(F.when(seed, F.col("s.end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(seed, F.col("s.start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    told = each.select("row", "s", before.alias("ended"), after.alias("starts"))
    touches = (F.coalesce("ended", F.lit(0)) > F.col("s.start")) | (F.coalesce("starts", F.col("s.end")) < F.col("s.end"))
    return told.filter((F.col("s.kind") < 0) & ~touches).select("row", "s")


def _may_be(kind: int, match: Column) -> Column:
    """Whether a candidate has the shape of a kind."""
    n = _digits(match)
    spelled = match.rlike(r"[\[(]at[\])]")
    return {
        "email": spelled,
        "ip": ~spelled & match.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
        "card": ~spelled & n.between(12, 19),
        "phone": ~spelled & n.between(7, 15),
    }[KINDS[kind]]


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")


def _edges(found: DataFrame) -> DataFrame:
    """Occurrences by pattern: ``row, start, end, kind, instance, pattern``."""
    shape = F.regexp_replace(F.regexp_replace("s.match", r"\p{L}+", "a"), r"\p{N}", "0")
    joined = lambda mark, *parts: F.concat(F.lit(mark), *[x for c in parts for x in (F.lit(" "), c)])  # noqa: E731  # null if a part is
    sides = F.array(joined("<", "s.left"), joined(">", "s.right"), joined("<<", "s.left2", "s.left"), joined(">>", "s.right", "s.right2"), joined("<>", "s.left", "s.right"), joined("<#", "s.left", shape))
    each = found.select("row", "s.start", "s.end", "s.kind", F.lower("s.match").alias("instance"), F.explode(F.filter(sides, lambda p: p.isNotNull())).alias("pattern"))
    return each


def _bootstrap(seeds: DataFrame, candidates: DataFrame, hold: Cuts) -> DataFrame:
    """Accepted candidates: ``row, start, end, kind``.

    Both inputs have a row for each occurrence; candidates have ``kinds``, all
    that their shape allows, instead of a kind.
    """
    open_kinds = candidates.withColumn("kind", F.explode("kinds")).drop("kinds")
    edges = hold(
        seeds.select("pattern", "kind", "instance", F.lit(True).alias("seed"))
        .union(open_kinds.select("pattern", "kind", "instance", F.lit(False)))
        .groupBy("pattern", "kind", "instance")
        .agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
        .withColumn("known", F.col("seed").cast("double"))
    )
    # what a pattern occurs with, of whatever kind, each occurrence once
    totals = hold(seeds.select("pattern").union(candidates.select("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("total")))
    n_good = -1
    while True:
        own = edges.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("known")).alias("hits"), F.count_if(F.col("known") > 0).alias("support"))
        patterns = own.join(totals, "pattern").select("pattern", "kind", "support", (F.col("hits") / (F.col("total") + PRIOR)).alias("score"))
        good = hold(patterns.filter((F.col("score") >= CONFIDENT) & (F.col("support") >= SUPPORT)))
        n_before, n_good = n_good, good.count()
        if n_good in (0, n_before):
            break
        instances = edges.join(good, ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("best"))
        edges = hold(edges.join(instances, ["instance", "kind"], "left").withColumn("known", F.greatest("known", F.coalesce("best", F.lit(0.0)))).drop("best"))
    taken = open_kinds.join(good, ["pattern", "kind"]).groupBy("row", "start", "end").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
    return taken.select("row", "start", "end", (-F.col("b.col2")).alias("kind"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans``; counts are of base spans."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), MARK, OTHER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = cut(rows.select("row", "doc_id", _base(F.col("text")).alias("base"), _candidates(F.col("text")).alias("loose")))
    with Cuts(docs.sparkSession) as hold:
        seeds = hold(_edges(rows.select("row", F.explode("base").alias("s"))))
        kinds = F.array(*[F.when(_may_be(k, F.col("instance")), F.lit(k)) for k in range(len(KINDS))])
        loose = hold(_edges(_free(rows)).withColumn("kinds", F.array_compact(kinds)).drop("kind"))
        added = _bootstrap(seeds, loose, hold)
        per_row = cut(added.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more")))
    plain = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))
    all_spans = F.concat(plain, F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:int>>")))
    by_start = F.array_sort(all_spans, lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(a.kind - b.kind))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    out = rows.join(per_row, "row", "left")
    return out.select("doc_id", *counts, _written(F.col("base")).alias("base"), _written(by_start).alias("spans"))
