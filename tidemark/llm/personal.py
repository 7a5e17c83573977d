"""Personal data by candidate generation and gradient-boosted trees, in DataFrame operations.

High-recall patterns propose overlapping spans: the strict forms of an address
and looser ones (blanks around the at sign, spelled-out or bracketed signs,
numbers without a country code, other separators, IPv6).  Each candidate is
described by format and context in a few small whole numbers.  Candidates that
agree in all of them are one cell of a table with CELLS cells at most, counted
over the whole corpus; trees are boosted on that table.  True are candidates
that meet a strict span that passes its check, and, for each such span, the
cell it would be in if written in disguise; false are strict and loose matches
that fail their checks.  Loose matches that are plausible may be either.  Which
words tell a kind is learnt from the corpus, in any language: the word before a
span, and the two words before it, tell a kind if they stand before its true
strict spans TELLING times as often as before failing ones and other kinds'.
Words and trees are learnt from one half of the texts (by their checksum); how
often such words stand before true and false spans is counted on the other
half.  From that, and how often they stand before the plausible loose matches,
follows what share of these is true, and they count as true in that share.
Where signs stand in brackets, as in "(at)" or "[.]", the format alone tells.  A
kind's threshold is the lowest score above which, on the second half, the share
of true ones is still PRECISION.  Strict spans that pass their checks are always
kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut

KINDS = ("email", "ip", "card", "phone")
#: The strict forms.  Possessive runs and look-behind keep long texts linear; they match what the plain forms match, leftmost first.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAME, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
LOOSE = {
    "email": rf"{_NAME}(?: ?@ ?{_HOST}(?: ?\. ?{_HOST})*+| ?[\[({{<] ?(?i:at) ?[\])}}>] ?{_HOST}(?: ?(?:\.|[\[({{<] ?(?i:dot) ?[\])}}>]) ?{_HOST})++| (?i:at) {_HOST}(?: (?i:dot) {_HOST})++)",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4,6}){2}(?:[ ._/-]{1,2}[0-9]{1,7})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{2,4}\)|00[1-9][0-9]{0,2}|[0-9]{3,4})[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])",
}
#: Sizes of the features: kind, digits, separators, checksum, sign, groups of digits, ending, left context, right context.
SIZES = (4, 7, 5, 2, 3, 4, 2, 3, 2)
_SIGN, _LEFT = 4, 7
CELLS = math.prod(SIZES)
PRECISION, TREES, RATE = 0.95, 20, 0.3
_MARK, _OTHER = "\u0001", "\u0002"
#: Words are told apart by hash: so many single ones, and as many pairs.  A telling one stands before LEAST_WORDS true spans or more.
WORDS, TELLING, LEAST_WORDS = 1 << 13, 4, 3
_BRACKETED = r"(?i)[\[({<] ?(?:at|dot|\.) ?[\])}>]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether 12 to 19 digits pass Luhn's check."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = d.substr(i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _passes(kind: str, s: Column) -> Column:
    """Whether a strict match is what it looks like."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    return _luhn(_digits(s)) if kind == "card" else F.length(_digits(s)).between(9, 15)


def _plausible(kind: str, s: Column) -> Column:
    """Whether a loose match can be what it looks like: digits that pass the checks, no date."""
    d = _digits(s)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s.contains(":") | _passes("ip", F.regexp_replace(s, r"[\[\]()]", ""))
    date = s.rlike(r"^(?:19|20)[0-9]{2}[ ./-]") | s.rlike(r"[ ./-](?:19|20)[0-9]{2}$")
    return _luhn(d) if kind == "card" else F.length(d).between(7, 15) & ~date


def _code(kind: str, s: Column, left: Column, right: Column) -> Column:
    """The cell of a candidate."""
    d = _digits(s)
    n = F.length(d)
    digits = F.when(n < 4, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).when(n < 20, 5).otherwise(6)
    marks = F.regexp_replace(s, "[A-Za-z0-9+@]", "")
    separators = F.when(marks == "", 0).when(marks.rlike("^ +$"), 1).when(marks.rlike("^[ ()-]+$"), 2).when(marks.rlike("^[.]+$"), 3).otherwise(4)
    runs = F.regexp_count(s, F.lit("[0-9]+"))
    groups = F.when(runs < 2, 0).when(runs < 4, 1).when(runs == 4, 2).otherwise(3)
    ending = s.rlike("[. )\\]}>][A-Za-z]{2,6}$").cast("int")
    before = left.rlike("[A-Za-z0-9@_+]$").cast("int")  # 2: after a telling word, see _named
    after = F.when(right.rlike("^[A-Za-z0-9@_]"), 1).otherwise(0)
    sign = F.when(s.rlike(_BRACKETED), 2).otherwise(F.contains(s, F.lit("@")).cast("int"))
    values = [F.lit(KINDS.index(kind)), digits, separators, _luhn(d).cast("int"), sign, groups, ending, before, after]
    code = F.lit(0)
    for v, size in zip(values, SIZES, strict=True):
        code = code * size + v
    return code


def _named(code: Column) -> Column:
    """The cell of a candidate after a telling word."""
    below = math.prod(SIZES[_LEFT + 1 :])
    return (code + (2 - F.floor(code / below) % SIZES[_LEFT]) * below).cast("int")


def _word(left: Column, pair: bool) -> Column:
    """Number of the last word, or of the last two, if they end within eight code points before a candidate."""
    found = F.regexp_extract(left, r"(\p{L}+[^\p{L}]+\p{L}+)[^\p{L}]{1,8}$" if pair else r"(\p{L}+)[^\p{L}]{1,8}$", 1)
    number = F.pmod(F.xxhash64(F.regexp_replace(F.lower(found), r"[^\p{L}]+", " ")), F.lit(WORDS)).cast("int")
    return F.when(found != "", number + WORDS * pair)


def _disguised(kind: str, s: Column) -> Column:
    """A passing strict span as people write it to hide it from such patterns."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(s, "@", " (at) "), r"\.", " (dot) ")
    return F.regexp_replace(s, r"\.", "[.]") if kind == "ip" else F.regexp_replace(F.regexp_replace(s, "[ -]", ""), "([0-9]{4})(?=[0-9])", "$1.") if kind == "card" else F.regexp_replace(s, r"^\+[0-9]{1,3} ?", "")


def _found(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<kind, start, end, ok, may, code, hidden, w1, w2>> of one pattern's leftmost matches; ``ok``: strict and passing; ``may``: loose and plausible; ``hidden``: then the cell of its disguise; ``w1``, ``w2``: words before."""
    pieces = F.split(F.regexp_replace(text, (STRICT if strict else LOOSE)[kind], f"{_MARK}$0{_MARK}"), _MARK)

    def spans(x: Column) -> Column:
        p, e = x["p"], x["e"]

        def one(i: Column) -> Column:
            s, left, right = F.get(p, i), F.right(F.get(p, i - 1), F.lit(40)), F.left(F.get(p, i + 1), F.lit(4))
            ok = _passes(kind, s) if strict else F.lit(False)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                F.get(e, i - 1).alias("start"),
                F.get(e, i).alias("end"),
                ok.alias("ok"),
                (F.lit(False) if strict else _plausible(kind, s)).alias("may"),
                _code(kind, s, left, right).alias("code"),
                (F.when(ok, _code(kind, _disguised(kind, s), left, right)) if strict else F.lit(None).cast("int")).alias("hidden"),
                _word(left, False).alias("w1"),
                _word(left, True).alias("w2"),
            )

        odd = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(odd, one)

    empty = F.array().cast("array<struct<kind:int,start:int,end:int,ok:boolean,may:boolean,code:int,hidden:int,w1:int,w2:int>>")
    # an array of one element stands for a name: what is split once is used several times
    with_ends = lambda x: F.transform(F.array(F.struct(x["p"].alias("p"), _ends(x["p"]).alias("e"))), spans)
    return F.element_at(F.transform(F.array(F.struct(pieces.alias("p"))), lambda x: F.when(F.size(x["p"]) > 1, F.element_at(with_ends(x), 1)).otherwise(empty)), 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: an array of one element stands for a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(x: Column) -> Column:
    """Running sums of a short array."""
    return F.aggregate(x, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))


#: Lengths summed in one go: what is put together piece by piece stays short, so the cost of a text is linear.
_GO = 256


def _ends(pieces: Column) -> Column:
    """Running sums of the pieces' lengths in code points."""

    def summed(lengths: Column) -> Column:
        goes = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _GO).cast("int")), lambda k: _running(F.slice(lengths, k * _GO + 1, F.lit(_GO))))
        return _let(goes, lambda g: _let(_running(F.transform(g, lambda x: F.element_at(x, -1))), lambda upto: F.flatten(F.transform(g, lambda x, k: F.transform(x, lambda n: n + F.when(k > 0, F.get(upto, k - 1)).otherwise(0))))))

    return _let(F.transform(pieces, F.length), summed)


def candidates(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, half, c): all spans that the patterns propose in each row's whole text, with their cells; ``half``: 0 to learn from, 1 held out."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, _OTHER)
    rows = docs.select("doc_id", text.alias("t"))
    lists = [_found(F.col("t"), kind, strict).alias(f"{kind}_{int(strict)}") for kind in KINDS for strict in (True, False)]
    names = [f"{kind}_{int(strict)}" for kind in KINDS for strict in (True, False)]
    half = (F.crc32(F.col("t").cast("binary")) % 2).cast("int").alias("half")
    return rows.select("doc_id", half, *lists).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "half", F.concat(*names).alias("c"))


def telling_words(spans: DataFrame) -> DataFrame:
    """(kind, word): the words that tell a kind, len(KINDS) * 2 * WORDS at most, from spans with kind, ok, label, w1 and w2.

    Of failing spans and true ones of other kinds together, the share after such
    a word is less than that of the kind's true ones by the factor TELLING.
    """
    every = F.lit(-1)  # stands before each span: its counts are the totals
    seen = spans.where(F.col("ok") | (F.col("label") == 1)).select("kind", "ok", F.explode(F.array(every, "w1", "w2")).alias("word")).where("word IS NOT NULL")
    true = [F.count_if(F.col("ok") & (F.col("kind") == k)).alias(f"t{k}") for k in range(len(KINDS))]
    words = cut(seen.groupBy("word").agg(F.count("*").alias("n"), *true))
    total = words.where("word = -1").first() or {"n": 0} | {f"t{k}": 0 for k in range(len(KINDS))}
    tells = []
    for k in range(len(KINDS)):
        t, of_true, others = F.col(f"t{k}"), total[f"t{k}"], total["n"] - total[f"t{k}"]
        often = t * (others + 1) >= TELLING * (F.col("n") - t + 1) * of_true
        tells.append(F.when((t >= LEAST_WORDS) & often, k))
    return words.where("word >= 0").select("word", F.explode(F.array(*tells)).alias("kind")).where("kind IS NOT NULL")


def _one_hot() -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Flags of every cell for each (feature, value)."""
    values = np.stack(np.unravel_index(np.arange(CELLS), SIZES), axis=1)
    names = [(f, v) for f, size in enumerate(SIZES) for v in range(size)]
    return np.stack([values[:, f] == v for f, v in names], axis=1), names


def boost(counts: np.ndarray, true: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[list, np.ndarray]:
    """Trees of two levels boosted on the cells' logistic loss, and each cell's score (log-odds)."""
    flags, names = _one_hot()
    score, model = np.zeros(CELLS), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> int:
        gain = lambda a, b: a * a / (b + 1.0)
        inside = flags & rows[:, None]
        gi, hi, ga, ha = g @ inside, h @ inside, g[rows].sum(), h[rows].sum()
        return int(np.argmax(gain(gi, hi) + gain(ga - gi, ha - hi)))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = true - counts * p, counts * p * (1 - p)
        root = split(np.ones(CELLS, bool), g, h)
        tree = [root]
        for side in (flags[:, root], ~flags[:, root]):
            low = split(side, g, h)
            leaf = []
            for part in (side & flags[:, low], side & ~flags[:, low]):
                step = rate * g[part].sum() / (h[part].sum() + 1.0)
                score[part] += step
                leaf.append(float(step))
            tree.append((low, *leaf))
        model.append([(names[tree[0]]), *((names[low], a, b) for low, a, b in tree[1:])])
    return model, score


def thresholds(counts: np.ndarray, true: np.ndarray, score: np.ndarray) -> list[float]:
    """For each kind the lowest score at which, and above which, the share of true candidates is PRECISION; infinite if none.

    Candidates of one score are in or out together, and where most of them are false they are out, with all below.
    """
    kind = np.unravel_index(np.arange(CELLS), SIZES)[0]
    out = []
    for k in range(len(KINDS)):
        at = np.flatnonzero((kind == k) & (counts > 0))
        levels, place = np.unique(-np.round(score[at], 9), return_inverse=True)
        n, t = np.bincount(place, counts[at], len(levels)), np.bincount(place, true[at], len(levels))
        good = (np.cumsum(t) >= PRECISION * np.cumsum(n)) & np.logical_and.accumulate(2 * t >= n)
        out.append(float(-levels[np.flatnonzero(good)[-1]]) if good.any() else math.inf)
    return out


def _scored(code: Column, model: list) -> Column:
    """The trees' sum as an expression."""
    below = [math.prod(SIZES[f + 1 :]) for f in range(len(SIZES))]
    has = lambda fv: (F.floor(code / below[fv[0]]) % SIZES[fv[0]]) == fv[1]
    total = F.lit(0.0)
    for root, (a, a1, a0), (b, b1, b0) in model:
        total = total + F.when(has(root), F.when(has(a), a1).otherwise(a0)).otherwise(F.when(has(b), b1).otherwise(b0))
    return total


def labels(held_true: np.ndarray, held_false: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The share of each cell's ``open_`` candidates that counts as true: all where signs stand in brackets, else what the words before tell.

    ``held_true`` and ``held_false`` are counts of texts that the words weren't learnt from.
    """
    features = np.unravel_index(np.arange(CELLS), SIZES)
    plain = features[_SIGN] != 2
    expected = np.where(plain, 0.0, 1.0)
    for kind in range(len(KINDS)):
        own = features[0] == kind
        named = own & (features[_LEFT] == 2)
        rate = lambda x: (x[named].sum() + 0.1) / (x[own].sum() + 1)  # noqa: B023, E731
        p, n, u = rate(held_true), rate(held_false), open_[named & plain].sum() / max(open_[own & plain].sum(), 1.0)
        share = float(np.clip((u - n) / (p - n), 0, 1)) if p > n + 0.05 else 0.0
        for cells, of_true, of_all in ((named & plain, p, u), (own & plain & ~named, 1 - p, 1 - u)):
            expected[cells] = min(1.0, share * of_true / of_all) if of_all > 0 else 0.0
    return expected


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``.

    Counts and hash are of the strict spans that pass their checks, ``spans``
    also has what the trees add: plausible loose candidates over their kind's
    threshold that don't overlap a strict span.  Null and empty texts have no
    spans; repeated rows, and rows without doc_id, are rows like others.  A
    text's work is linear in its matches (but for sorting them).  Texts that are
    all in one half, such as a single one, get strict spans only.
    """
    found = cut(candidates(docs))
    spans = found.where(F.size("c") > 0).select("uid", "half", F.explode("c").alias("x")).select("uid", "half", "x.*")
    # of spans in order of their starts, those that begin before and reach in, or begin inside, meet
    by_text, by_kind = ["uid"], ["uid", "kind"]

    def meets(by: list[str], which: str = "ok") -> Column:
        before, behind = (Window.partitionBy(*by).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
        reach = F.max(F.when(F.col(which), F.col("end"))).over(before)
        begin = F.min(F.when(F.col(which), F.col("start"))).over(behind)  # a frame that runs to the end would be summed anew for each row
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(begin < F.col("end"), F.lit(False))

    # what fails its check within a plausible one is a part of that, and no example of its own
    label = F.when(meets(by_kind), 0).when(F.col("may"), 2).when(~meets(by_text, "may"), 1)
    spans = cut(spans.withColumn("label", label).withColumn("met", meets(by_text)))
    telling = cut(telling_words(spans.where("half = 0")))
    for w in ("w1", "w2"):  # at most one row of ``telling`` a span
        spans = spans.join(F.broadcast(telling.select("kind", F.col("word").alias(w), F.lit(True).alias(f"by_{w}"))), ["kind", w], "left")
    told = F.col("by_w1").isNotNull() | F.col("by_w2").isNotNull()
    spans = spans.withColumns({c: F.when(told, _named(F.col(c))).otherwise(F.col(c)) for c in ("code", "hidden")})
    seen = spans.select("half", "code", "label").union(spans.where("ok").select("half", "hidden", F.lit(0)))
    cells = seen.groupBy("half", "code").agg(*(F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(3))).collect()  # 2 * CELLS rows at most
    table = np.zeros((2, 3, CELLS))
    for r in cells:
        table[r["half"], :, r["code"]] = r["n0"], r["n1"], r["n2"]
    (learn_true, learn_false), (held_true, held_false), open_ = table[0, :2], table[1, :2], table[:, 2].sum(axis=0)
    share = labels(held_true, held_false, open_)
    model, score = boost(learn_true + learn_false + open_, learn_true + open_ * share)
    counts, true = held_true + held_false + open_, held_true + open_ * share
    least = F.array(*(F.lit(x) for x in thresholds(counts, true, score)))
    # a cell's score is the trees' sum; its kind's threshold decides
    added = F.col("may") & ~F.col("met") & (_scored(F.col("code"), model) >= F.get(least, F.col("kind")) - 1e-8)
    span = F.struct("start", "kind", "end")
    word = F.array(*(F.lit(k) for k in KINDS))

    def joined(spans: Column) -> Column:
        ordered = F.array_sort(F.array_distinct(spans))
        return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(word, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    counted = [F.count_if(F.col("ok") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    texts = spans.where(F.col("ok") | added).groupBy("uid").agg(*counted, joined(F.collect_list(F.when(F.col("ok"), span))).alias("base"), joined(F.collect_list(span)).alias("spans"))
    rows = found.select("uid", "doc_id").join(texts, "uid", "left")
    numbers = [F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS]
    return rows.select("doc_id", *numbers, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
