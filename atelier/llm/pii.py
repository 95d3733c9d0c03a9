"""Personal data by patterns, and terms that reveal it by information content. Native expressions throughout.

Base spans are the leftmost matches of four kinds, found natively: the gaps between matches (`split`) and the matches give
every span's code points. Matches that fail their check are dropped; one with more digits than its kind may have becomes
a `number`, as it may hide a card or phone that stands next to other digits.

The method: a protected entity e is a base value, or what base values share (an address's domain, a network, a card's issuer, a phone's
area), so that values seen once share evidence; entities are known by hashes. Texts are cut into windows of `window`
words, over line breaks, entities as one word each. Over all windows of all documents n_e, n_t and n_et count those that hold e,
the term t, and both. Of the -log2(n_e / N) bits that name the entity a term reveals log2(n_et N / (n_e n_t)); where that part reaches
`threshold`, in `support` windows with different words at least, knowing the term nearly gives the entity away. Such a term becomes a span of kind
`term` wherever it stands, in any document, and `sanitise` generalises it to a class of words. Copies of a window count
once towards `support`, so copying a text does not make its words telling.

Every count is a grouped sum over all documents with partial sums before the shuffle. A window has at most `window` words, so
pairs grow with the text; only counts of terms that stand with an entity are kept. Work on one text grows with its length to the power 1.5 at most,
whatever it holds (prefix sums and cuts go by blocks).

Nulls: a null text is empty and has no spans. Repeated rows are judged alike. Ties: a term that meets the threshold exactly is a span. Very
long texts are searched whole. Empty tables give empty results. All columns of docs are kept, but one named as `result_col` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_TERMS, stored

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Possessive and anchored at a run's begin, which changes no match but keeps long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


TERM, NUMBER = "term", "number"
#: Digits beyond which a dropped match is a `number`: it may hide a card or phone next to other digits.
MOST = {"card": 19, "phone": 15}


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    """An array of about sqrt(n) arrays of consecutive values; one at least."""
    width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(values)))).cast("int")
    return _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / w).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * w + 1, w)))


def _folded(values: Column, first: Column, step) -> Column:
    """(at, out): the fold of all values, and the folds before each."""
    begin = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, begin, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))


def _running(values: Column, step) -> Column:
    """For each value (longs) the fold by `step` (sum or greatest) of 0 and the values before it: an array one longer than `values`.

    Goes by blocks, as appending to an array copies it.
    """
    zero = F.lit(0).cast("long")

    def by(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
        inner = lambda bases: F.concat(F.flatten(F.zip_with(blocks, bases["out"], lambda block, at: _folded(block, at, step)["out"])), F.array(bases["at"]))
        return _let(_folded(sums, zero, step), inner)

    return _let(values, lambda v: _let(_blocks(v), by))


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches: code points, end exclusive."""
    none = F.array().cast("array<struct<start: bigint, end: bigint, value: string>>")

    def of(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, value: (F.length(gap) + F.length(value)).cast("long"))
        out = lambda ends: F.zip_with(F.slice(ends, 2, F.size(found)), found, lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")))
        return F.when(F.size(found) > 0, _let(_running(steps, lambda x, y: x + y), out)).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes Luhn's check."""

    def step(state: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return state + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _fits(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.length(p).between(0, 3) & (F.when(p == "", 0).otherwise(F.substring(p, 1, 3).try_cast("int")) <= 255)
        return F.forall(F.split(value, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as listed, then by start; with it dropped matches that are a `number`."""
    return F.concat(*(_spans_of(kind, text) for kind in KINDS))


def _spans_of(kind: str, text: Column) -> Column:
    def named(s: Column) -> Column:
        what = F.when(_fits(kind, s["value"]), F.lit(kind))
        if kind in MOST:
            what = what.when(F.length(F.regexp_replace(s["value"], "[^0-9]", "")) > MOST[kind], F.lit(NUMBER))
        return F.struct(what.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))

    own = F.filter(F.transform(_places(text, PATTERNS[kind]), named), lambda s: s["kind"].isNotNull())
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint, value: string>>")
    return F.when(F.contains(text, F.lit(HINTS[kind])), own).otherwise(none) if HINTS[kind] else own


def _replaced(text: Column, spans: Column, mask, every: bool = False) -> Column:
    """The text with mask(span, its code points not yet replaced) in place of each span; what lies in a span before it is skipped, or with `every` masked too.

    Spans go in blocks of about sqrt(n), each of which cuts its own part of the text first.
    """

    def block(own: Column) -> Column:
        base, end = own[0]["at"], F.element_at(own, -1)["s"]["start"]

        def cut(part: Column) -> Column:
            gap = lambda x: F.substring(part, (x["at"] - base + 1).cast("int"), F.greatest(x["s"]["start"] - x["at"], F.lit(0)).cast("int"))
            return F.array_join(F.transform(own, lambda x: F.concat(gap(x), mask(x["s"], F.greatest(x["s"]["end"] - F.greatest(x["at"], x["s"]["start"]), F.lit(0)).cast("int")))), "")

        return _let(F.substring(text, (base + 1).cast("int"), F.greatest(end - base, F.lit(0)).cast("int")), cut)

    def ordered(order: Column) -> Column:
        def placed(reach: Column) -> Column:
            both = F.zip_with(order, F.slice(reach, 1, F.size(order)), lambda s, at: F.struct(s.alias("s"), at.alias("at")))
            both = both if every else F.filter(both, lambda x: x["s"]["start"] >= x["at"])
            rest = F.substring(text, (F.element_at(reach, -1) + 1).cast("int"), F.length(text))
            return F.concat(F.array_join(F.transform(_let(both, _blocks), block), ""), rest)

        return _let(_running(F.transform(order, lambda s: s["end"].cast("long")), lambda x, y: F.greatest(x, y)), placed)

    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int")).otherwise(F.sign(b["end"] - a["end"]).cast("int")))
    return F.when(F.size(spans) > 0, _let(order, ordered)).otherwise(text)


#: Begins and ends an entity's number in the words of a window; a text's own characters of this kind count as blanks.
_SIGN = "\ue000"
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _entities(span: Column) -> Column:
    """Hashes of the value and of what it shares with others of its kind."""
    kind, value = span["kind"], F.translate(span["value"], UPPER, LOWER)
    digits = F.regexp_replace(value, "[^0-9]", "")
    own = F.when(kind.isin("card", "phone"), digits).otherwise(value)
    shared = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.substring_index(value, ".", 3), F.lit(".")))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7))
    )
    return F.array(F.xxhash64(kind, F.lit("value"), own), F.xxhash64(kind, F.lit("shared"), shared))


def _windows(text: Column, spans: Column, window: int) -> Column:
    """Array of arrays of `window` words; entity i of `spans` is the word _SIGN i _SIGN."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i")))
    blank = F.translate(text, _SIGN, " ")
    marked = F.when(F.size(spans) > 0, _replaced(blank, numbered, lambda s, _: F.concat(F.lit(f" {_SIGN}"), s["i"].cast("string"), F.lit(f"{_SIGN} ")), every=True)).otherwise(blank)
    words = F.filter(F.split(F.translate(marked, UPPER, LOWER), _SEPARATORS), lambda w: w != "")
    return _let(words, lambda all: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(all) - 1) / window).cast("int"), F.lit(0))), lambda i: F.slice(all, i * window + 1, window)))


def _is_entity(word: Column) -> Column:
    return word.startswith(_SIGN)


def told(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """From rows of text and spans: (entity, term, n_et, n_contexts) and (entity, n_e), stored."""
    w = F.col("w")
    holding = rows.where(F.exists("spans", lambda s: s["kind"] != NUMBER)).select("spans", F.explode(_windows(F.col("text"), F.col("spans"), window)).alias("w"))
    named = F.transform(F.filter(w, _is_entity), lambda x: F.element_at("spans", F.regexp_replace(x, _SIGN, "").cast("int") + 1))
    entities = F.array_distinct(F.flatten(F.transform(F.filter(named, lambda s: s["kind"] != NUMBER), _entities)))
    plain = F.filter(w, lambda x: ~_is_entity(x))
    own = holding.select(entities.alias("entities"), F.xxhash64(plain).alias("context"), F.array_distinct(plain).alias("terms")).where(F.size("entities") > 0)
    own = stored(own, "pii-windows")
    pairs = own.select("context", F.explode("entities").alias("entity"), "terms").select("context", "entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("n_contexts"))
    return pairs, own.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))


def telling(rows: DataFrame, window: int, threshold: float, support: int) -> DataFrame:
    """(entity, term, n_et, n_e, n_t, n, bits, worth) of the terms that reveal an entity; rows have text and spans."""
    pairs, held = told(rows, window)
    pairs = stored(pairs.where(F.col("n_contexts") >= support).join(held, "entity"), "pii-pairs")
    asked = stored(pairs.select("term").union(pairs.sparkSession.createDataFrame([("",)], "term string")).distinct(), "pii-terms")  # the empty term stands for the window itself
    few = asked.count() <= BROADCAST_TERMS
    own = F.flatten(F.transform(_windows(F.col("text"), F.col("spans"), window), lambda w: F.concat(F.array(F.lit("")), F.array_distinct(w))))
    counted = rows.select(F.explode(own).alias("term")).join(F.broadcast(asked) if few else asked, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    counted = stored(counted, "pii-counts")
    n = (counted.where("term = ''").first() or [0, 0])[1]
    bits = F.log2(F.col("n_et") * float(n) / (F.col("n_e") * F.col("n_t").cast("double")))
    worth = -F.log2(F.col("n_e") / F.lit(float(n or 1)))
    found = pairs.join(counted, "term").select("entity", "term", "n_et", "n_e", "n_t", F.lit(n).alias("n"), bits.alias("bits"), worth.alias("worth"))
    return found.where((F.col("worth") > 0) & (F.col("bits") >= threshold * F.col("worth") - 1e-9))


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True, window: int = 128, threshold: float = 0.9, support: int = 2, result_col: str = "pii") -> DataFrame:
    """Adds array `result_col` of spans (kind, start, end): base ones by kind and start, then by start long
    numbers (kind `number`) and revealing terms (kind `term`).

    `window`: words in which an entity and a term count as one another's context. keep_text=False leaves the text out.
    """
    names = [c for c in docs.columns if c.lower() != result_col.lower() and c != text_col]
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]
    rows = docs.select(*kept, F.col(text_col).alias("given"), base_spans(_text(text_col)).alias("spans"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pii-rows").withColumn("text", _text("given"))

    terms = stored(telling(rows, window, threshold, support).select("term").distinct(), "pii-telling")
    few = terms.count() <= BROADCAST_TERMS
    own = F.array_distinct(F.flatten(_windows(F.col("text"), F.col("spans"), window)))
    hit = rows.select("row", F.explode(own).alias("term")).join(F.broadcast(terms) if few else terms, "term").groupBy("row").agg(F.collect_set("term").alias("terms"))  # a document's own words
    hit = stored(hit, "pii-hit")
    small = (hit.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_TERMS
    blank = _replaced(F.col("text"), F.col("spans"), lambda _, n: F.repeat(F.lit(" "), n))
    places = F.filter(_places(F.col("blank"), WORD), lambda t: F.array_contains("terms", t["value"]))
    extra = rows.join(F.broadcast(hit) if small else hit, "row").select("row", "terms", F.translate(blank, UPPER, LOWER).alias("blank")).select("row", F.transform(places, lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))).alias("extra"))
    extra = stored(extra, "pii-term-spans")

    plain = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(F.filter(plain, lambda s: s["kind"] != NUMBER), F.array_sort(F.filter(plain, lambda s: s["kind"] == NUMBER)))
    none = F.array().cast("array<struct<kind: string, start: bigint, end: bigint>>")
    whole = rows.join(F.broadcast(extra.select("row")) if small else extra.select("row"), "row", "left_anti").withColumn("extra", none)
    whole = whole.unionByName(rows.join(F.broadcast(extra) if small else extra, "row"))
    back = [F.col(f"k{names.index(c)}").alias(c) if c != text_col else F.col("given").alias(c) for c in docs.columns if c in names or (keep_text and c == text_col and c.lower() != result_col.lower())]
    return whole.select(*back, F.concat(base, "extra").alias(result_col))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each base span replaced by its kind in brackets and each term by a class of words; overlapping spans go as one."""
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    word = lambda s: F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    mask = lambda s, _: F.when(s["kind"] != TERM, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(word(s).rlike("[0-9]"), "[CODE]").when(word(s).rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    return _replaced(text, order, mask)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
