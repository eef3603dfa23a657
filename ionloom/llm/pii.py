"""Personal data: base patterns, and information-theoretic sanitisation of the words around them.

Base spans are e-mail addresses, IP addresses, card and phone numbers. A protected entity is a value of these. From the
whole corpus the operator estimates how strongly a word reveals an entity. In a text d that holds entities, term t weighs

    w(d, t) = tf(d, t) (1 - x(d)) + BESIDE b(d, t),

with b 1 if t stands within REACH words of a base span and x(d) the share of d's words that stand in no other text. So a
name seen once beside an address counts, while a text in a language or of parts of which the corpus has nothing else isn't
taken to reveal its one address by every word: where all words are new, a new word tells little. In a text without
entities t weighs tf. With n(t) the weight of t in all texts, n(e, t) in those that hold entity e, p(e) the share of all word
occurrences that stand in texts with e,

    p(e | t) = n(e, t) / (n(t) + PRIOR),

so that of the entity's information IC(e) = -log2 p(e) a term discloses PMI(e; t) = log2(p(e | t) / p(e)) bits and leaves

    IC(e) - PMI(e; t) = -log2 p(e | t).

A term that discloses something of an entity (PMI > 0) and leaves at most `generalise` bits is replaced by a class name, one
that leaves at most `remove` bits is dropped, wherever it stands in any text. The thresholds are bits left, not shares PMI / IC: IC grows with the
corpus, so at a fixed share ever weaker terms would count, down to words that hardly ever stand near the entity. PRIOR
occurrences elsewhere are taken to be unseen, so few occurrences reveal less than many and no number of texts is asked for.
DataFrame functions only.

Work in a text is n log n in its length: places come from scans of lengths, never from arrays that grow one by one, pieces of
a text are cut from short blocks, and terms are looked up by halving. Entities that stand in the same texts disclose alike and are
one class, so a text's terms don't meet each of its addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, table
from .common import remove as remove_paths

KINDS = ("email", "ip", "card", "phone")
#: Equal to the contract's patterns, but they begin only where a match can begin and never give characters back, so long runs cost linear time and no stack.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that every text with a match meets.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Occurrences elsewhere that are added to those of a term.
PRIOR = 2.0
#: Weight of standing beside a base span, and how many words away that is.
BESIDE, REACH = 2.0, 5
#: Characters of the blocks that pieces of a text are cut from.
BLOCK = 512
#: Marks the first place of a blanked base span.
_MARK = "\x01"
#: Bits of an entity that a term may leave: at 1 the entity is as likely as not where the term stands.
GENERALISE, REMOVE = 1.0, 0.42
#: Bits of a sieve for each key, hash functions, and its largest size (16 MB).
SIEVE_BITS, SIEVE_HASHES, SIEVE_MOST = 16, 2, 1 << 27
#: Tasks that the copies of one text are dealt over.
SALT = 16
_HITS = "array<struct<term:string,kind:int>>"
_SPAN = "array<struct<kind:int,s:int,e:int,value:string>>"


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn sum."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _let(value: Column, f) -> Column:
    """f(value) with value computed once: inside, it is a variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scan(values: Column, op) -> Column:
    """What op makes of each value and all before it, by doubling."""

    def run(v):
        strides = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda k: k < F.size(v))
        return F.aggregate(strides, v, lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= k, op(F.get(acc, i - k), x)).otherwise(x)))

    return _let(values, run)


def _sums(values: Column) -> Column:
    return _scan(values, lambda a, b: a + b)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """The code points from a to b (exclusive) of a text in blocks; empty if there are none."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(b > a, F.substring(joined, a - first * BLOCK + 1, b - a)).otherwise("")


def _rewritten(text: Column, spans: Column, new) -> Column:
    """text with each span replaced by new(span, place up to which the text is written before it); spans are sorted structs with s and e."""

    def run(x):
        ends = _scan(F.transform(x["spans"], lambda p: p["e"]), lambda a, b: F.greatest(a, b))

        def write(y):
            before = lambda i: F.coalesce(F.get(y["ends"], i - 1), F.lit(0))
            parts = F.transform(y["spans"], lambda p, i: F.concat(_piece(y["blocks"], before(i), p["s"]), new(p, before(i))))
            return F.concat(F.array_join(parts, ""), _piece(y["blocks"], before(F.size(y["ends"])), y["n"]))

        return _let(F.struct(ends.alias("ends"), x["spans"].alias("spans"), x["blocks"].alias("blocks"), x["n"].alias("n")), write)

    return _let(F.struct(spans.alias("spans"), _blocks(text).alias("blocks"), F.length(text).alias("n")), run)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, value), in code points. What stands between two matches is what split leaves."""

    def run(m):
        lengths = F.zip_with(F.slice(m["rests"], F.lit(1), F.size(m["values"])), m["values"], lambda r, v: F.length(r) + F.length(v))
        return F.zip_with(_sums(lengths), m["values"], lambda e, v: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("value")))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("rests")), run)


def _kept(matches: Column, kind: int) -> Column:
    valid = F.filter(matches, lambda m: _valid(KINDS[kind], m["value"]))
    return F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["s"].alias("s"), m["e"].alias("e"), F.lower(m["value"]).alias("value")))


def _of_kind(spans: str | Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def base_spans(text: Column) -> Column:
    """All valid base matches, by kind as listed, then start."""
    none = F.array().cast(_SPAN)
    found = []
    for i, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(_HINTS[kind])) if len(_HINTS[kind]) == 1 else text.rlike(_HINTS[kind])
        found.append(F.when(hint, _kept(_matches(text, _PATTERNS[kind]), i)).otherwise(none))
    return F.coalesce(F.concat(*found), none)


def _label(spans: Column, kinds=(*KINDS, "term", "removed")) -> Column:
    """kind:start:end of spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["s"].cast("string"), s["e"].cast("string"))), ",")


def _plain(text: Column, base: Column) -> Column:
    """The text with its base spans blanked, so that places stay; a mark stands at the start of each."""
    unmarked = F.translate(text, _MARK, " ")
    ordered = F.array_sort(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))

    def blank(x, at):
        n = x["e"] - F.greatest(x["s"], at)
        return F.when(n > 0, F.concat(F.lit(_MARK), F.repeat(F.lit(" "), n - 1))).otherwise("")

    return F.when(F.size(base) > 0, _rewritten(unmarked, ordered, blank)).otherwise(unmarked)


def _terms(plain: Column) -> Column:
    return F.filter(F.split(F.lower(plain), _GAP), lambda t: t != "")


def _beside(plain: Column) -> Column:
    """The distinct terms within REACH words of a base span of plain."""

    def run(parts):
        def near(p, i):
            after, before = F.when(i > 0, F.slice(p, 1, REACH)), F.when(i < F.size(parts) - 1, F.slice(p, F.greatest(F.size(p) - REACH + 1, F.lit(1)), REACH))
            return F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in (after, before)])

        return F.array_distinct(F.flatten(F.transform(parts, near)))

    return _let(F.transform(F.split(plain, _MARK, -1), _terms), run)


def _found(terms: Column, word: Column) -> Column:
    """The place (from 0) of word in sorted terms, by halving, or null."""
    strides = F.filter(F.array(*[F.lit(1 << k) for k in range(29, -1, -1)]), lambda k: k <= F.size(terms))
    last = F.aggregate(strides, F.lit(0), lambda p, k: F.when((p + k <= F.size(terms)) & (F.get(terms, p + k - 1) <= word), p + k).otherwise(p))
    return _let(last, lambda p: F.when(F.get(terms, p - 1) == word, p - 1))


def _places(plain: Column, hits: Column) -> Column:
    """Spans of the words of plain that are in hits, an array of (term, kind) in order of term; by start, in code points."""

    def run(m):
        lengths = F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["words"])), m["words"], lambda g, w: F.length(g) + F.length(w))
        kind = lambda w: F.get(m["kinds"], _found(m["terms"], w))
        spans = F.zip_with(_sums(lengths), m["words"], lambda e, w: F.struct(kind(F.lower(w)).alias("kind"), (e - F.length(w)).alias("s"), e.alias("e"), F.lower(w).alias("value")))
        return F.filter(spans, lambda x: x["kind"].isNotNull())

    return _let(F.struct(F.regexp_extract_all(plain, F.lit(_WORD), F.lit(0)).alias("words"), F.split(plain, _WORD, -1).alias("gaps"), F.transform(hits, lambda h: h["term"]).alias("terms"), F.transform(hits, lambda h: h["kind"]).alias("kinds")), run)


def _with_plain(docs: DataFrame) -> DataFrame:
    """(text, base, plain) of every row of docs that has a text."""
    rows = docs.where("text is not null").select("text").withColumn("base", base_spans(F.col("text")))
    return rows.withColumn("plain", _plain(F.col("text"), F.col("base")))


def disclosures(docs: DataFrame, prior: float = PRIOR, least: float = GENERALISE, paths: list[str] | None = None) -> DataFrame:
    """(entity, term, left) of pairs that leave `least` bits at most.

    docs has text. Counts weigh each row of docs, repeated ones too. Entities that stand in the same texts are named by
    the smallest. A term that stands in one text with entities only is paired with the rarest of these, of which it
    discloses most. The sums are cut into the shared folder, at paths that are added to paths.
    """
    rows = _with_plain(docs)
    vocabulary = rows.select(F.explode(_terms(F.col("plain"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    vocabulary = cut(vocabulary, "pii-vocabulary", paths)
    n = float(vocabulary.agg(F.sum("n_t")).first()[0] or 0)
    entity = lambda b: F.concat(b["kind"].cast("string"), F.lit(":"), b["value"])
    texts = rows.where("size(base) > 0").select(_text_id().alias("text_id"), F.array_distinct(F.transform("base", entity)).alias("entities"), "plain")
    texts = texts.groupBy("text_id").agg(F.count("*").alias("copies"), F.first("entities").alias("entities"), F.first("plain").alias("plain"))
    texts = cut(texts.select("text_id", "copies", "entities", _terms(F.col("plain")).alias("terms"), _beside(F.col("plain")).alias("beside")), "pii-texts", paths)

    # entities by the texts that hold them
    holds = texts.select("text_id", F.explode("entities").alias("entity"), (F.size("terms") * F.col("copies")).alias("n"))
    same = ["texts", "a", "b"]
    entities = holds.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"), F.bit_xor("text_id.a").alias("a"), F.bit_xor("text_id.b").alias("b")).where((F.col("n_e") > 0) & (F.col("n_e") < n))
    entities = cut(entities.withColumn("p_e", F.col("n_e") / n), "pii-entities", paths)
    held = holds.select("text_id", "entity").join(entities, "entity")
    held = held.groupBy("text_id").agg(F.sort_array(F.collect_set(F.struct("p_e", *same))).alias("held"))

    # each term of a text with entities: its occurrences, and whether it stands beside one
    terms = F.concat(F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("near"))), F.transform("beside", lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("near"))))
    words = texts.select("text_id", "copies", F.explode(terms).alias("t")).select("text_id", "copies", "t.*").groupBy("text_id", "copies", "term").agg(F.sum("tf").alias("tf"), F.sum("near").alias("near"))
    words = cut(words, "pii-words", paths)
    inside = words.groupBy("term").agg(F.sum(F.col("copies") * F.col("tf")).alias("m"), F.sum(F.col("copies") * F.col("near")).alias("beside"), F.count("*").alias("texts"), F.first("text_id").alias("own"))
    inside = cut(inside.join(vocabulary, "term").withColumn("outside", F.col("n_t") - F.col("m")), "pii-inside", paths)
    new = inside.where("texts = 1 AND outside = 0").groupBy(F.col("own").alias("text_id")).agg(F.sum("m").alias("new"))
    share = texts.select("text_id", (F.size("terms") * F.col("copies")).alias("all")).join(new, "text_id", "left")
    share = share.select("text_id", (1 - F.coalesce("new", F.lit(0)) / F.greatest("all", F.lit(1))).alias("known"))

    # terms that could disclose any entity if all their weight inside were one entity's
    most = F.col("m") + BESIDE * F.col("beside")
    likely = inside.where(most >= (F.col("outside") + most + prior) * 2.0**-least * (1 - 1e-9)).select("term", "outside")
    weight = F.col("copies") * (F.col("tf") * F.col("known") + BESIDE * F.col("near"))
    words = words.join(likely, "term").join(share, "text_id").select("text_id", "term", "outside", weight.alias("w"))
    sums = words.groupBy("term").agg(F.sum("w").alias("w_t"), F.count("*").alias("k"))
    words = words.join(sums, "term").withColumn("n_t", F.col("outside") + F.col("w_t")).join(held, "text_id")

    def within_reach(e):
        most = F.when(e["texts"] == 1, F.col("w")).otherwise(F.col("w_t")) / (F.col("n_t") + prior) * (1 + 1e-9)
        return (most >= 2.0**-least) & (most > e["p_e"])

    own = F.when(F.col("k") == 1, F.slice("held", 1, 1)).otherwise(F.col("held"))
    pairs = words.select("term", "n_t", "w", F.explode(F.filter(own, within_reach)).alias("e"))
    pairs = pairs.groupBy(*[f"e.{c}" for c in same], "term").agg(F.sum("w").alias("n_et"), F.first("n_t").alias("n_t"), F.first("e.p_e").alias("p_e"))
    share = F.col("n_et") / (F.col("n_t") + prior)
    names = entities.groupBy(*same).agg(F.min("entity").alias("entity"))
    return pairs.where((share > F.col("p_e")) & (share > 0)).withColumn("left", -F.log2(share)).where(F.col("left") <= least).join(names, same).select("entity", "term", "left")


def _sieve(rows: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """rows with _may: false only where the column is none of n keys. The bits are broadcast in blocks of 512 words of 64; a join that is exact follows, for rows that may match."""
    bits = min(SIEVE_MOST, max(1 << 15, 1 << (SIEVE_BITS * n - 1).bit_length()))
    at = lambda i: F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits))
    none = rows.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("mask"))
    mask = F.expr("shiftleft(1L, cast(at & 63 as int))")
    words = keys.select(F.explode(F.array(*map(at, range(SIEVE_HASHES)))).alias("at")).select(F.shiftright("at", 6).alias("w"), mask.alias("mask")).union(none).groupBy("w").agg(F.bit_or("mask").alias("mask"))
    blocks = words.groupBy(F.shiftright("w", 9).alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "mask"))), lambda x: x["mask"]).alias("_words"))
    rows = rows.withColumn("_may", F.lit(True))
    for i in range(SIEVE_HASHES):
        rows = rows.withColumn("_at", at(i)).withColumn("_block", F.shiftright("_at", 15)).join(F.broadcast(blocks), "_block")
        rows = rows.withColumn("_may", F.col("_may") & F.expr("getbit(element_at(_words, cast((shiftright(_at, 6) & 511) + 1 as int)), cast(_at & 63 as int)) = 1")).drop("_at", "_block", "_words")
    return rows


def _text_id() -> Column:
    """A text's id, of 128 bits."""
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))


def term_lists(docs: DataFrame, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(text_hash, hits): the disclosing terms, with their kinds, of the texts that have some, by the 64-bit hash of the text. Texts of one hash share a list of the terms of either, which changes neither: a term is disclosing in every text."""
    paths: list[str] = []
    left = disclosures(docs, prior, generalise, paths).groupBy("term").agg(F.min("left").alias("left"))
    hits = cut(left.select("term", F.when(F.col("left") <= remove, 5).otherwise(4).alias("kind")), "pii-terms", paths)
    n = hits.count()
    rows = _with_plain(docs).select(F.xxhash64("text").alias("text_hash"), F.explode(F.array_distinct(_terms(F.col("plain")))).alias("term"))
    found = _sieve(rows, "term", hits, n).where("_may").drop("_may").join(F.broadcast(hits) if n <= BROADCAST_ROWS else hits, "term")
    out = cut(found.groupBy("text_hash").agg(F.sort_array(F.collect_set(F.struct("term", "kind"))).alias("hits")), "pii-lists")
    remove_paths(docs.sparkSession, paths)
    return out


def with_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """(row, base, terms) of every row of docs, which is a struct in row: base spans and those of disclosing terms. Only texts that may hold such terms are shuffled; copies of one text are dealt over SALT tasks."""
    lists = term_lists(docs.select("text"), **thresholds)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("text_hash"))
    rows = _sieve(rows, "text_hash", lists, lists.count())
    clean = rows.where(~F.col("_may")).withColumn("hits", F.array().cast(_HITS))
    dealt = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rest = rows.where("_may").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")).join(dealt, ["text_hash", "_salt"], "left")
    rest = rest.withColumn("hits", F.coalesce("hits", F.array().cast(_HITS)))
    found = clean.select("row", "hits").union(rest.select("row", "hits")).withColumn("base", base_spans(F.col("row.text")))
    terms = F.when(F.size("hits") > 0, _places(_plain(F.col("row.text"), F.col("base")), F.col("hits")))
    return found.select("row", "base", F.coalesce(terms, F.array().cast(_SPAN)).alias("terms"))


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every row. Null texts are empty; repeated rows stay; other columns are ignored."""
    found = with_spans(docs.select("doc_id", "text"), **thresholds)
    counts = [F.size(_of_kind("base", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    by_kind = F.concat("base", _of_kind("terms", 4), _of_kind("terms", 5))
    return found.select("row.doc_id", *counts, F.sha2(_label(F.col("base")), 256).alias("base_sha256"), _label(by_kind).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with personal data replaced in text by <EMAIL>, <IP>, <CARD>, <PHONE> or <TERM>, removed terms dropped, and n_chars counted anew.

    Overlapping base spans are replaced together, under the name of the first. Texts without base spans and disclosing
    terms and all other columns stay as they are, whatever their names.
    """
    rows = with_spans(docs, **thresholds)
    text, spans = F.col("row.text"), F.concat("base", "terms")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    ordered = F.transform(ordered, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind")))
    masks = F.array(*[F.lit(f"<{k.upper()}>") for k in (*KINDS, "term")], F.lit(""))
    new = _rewritten(text, ordered, lambda x, at: F.when(x["s"] >= at, F.element_at(masks, x["kind"] + 1)).otherwise(""))
    hit = F.size("base") + F.size("terms") > 0
    rows = rows.select("row", F.when(hit, new).otherwise(text).alias("new"), hit.alias("hit"))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("hit"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find over all documents."""
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLE = {}
