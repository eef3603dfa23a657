"""Each operator against brute force, and its edge cases: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.llm import decontaminate, jaccard, langid, mixing, pii, tokencounts, topk, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_warc_round_trip_over_small_ranges(spark, tmp_path):
    big = "x" * 300_000
    rows = [(3, "http://a/\r\n", "p" * 200), (1, None, "p" * 200), (2, "u", "p" * 200), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", "p" * 200), (8, "é", big), (8, "é", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.archive_pages(pages), path)
    for size in (97, 1 << 20):
        got = warc.read_warc(spark, path, size).collect()
        assert len(got) == len(rows)
        kinds = sorted((r.record_id, r.record_type, r.refers_to or "") for r in got)
        assert ("urn:page:1", "response", "") in kinds and ("urn:page:3", "revisit", "urn:page:1") in kinds and ("urn:page:", "revisit", "urn:page:1") in kinds
        assert [k for k in kinds if k[0] in ("urn:page:6", "urn:page:7")] == [("urn:page:6", "response", ""), ("urn:page:7", "response", "")]
        assert {hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response"} == {True}
    assert warc.read_warc(spark, path).where("record_id = 'urn:page:8'").first().payload_length == 300_000


def test_warc_member_that_needs_a_pad():
    raw = warc.member("urn:page:1", "u", "response", None, "00", b"a" * (1 << 24))
    assert raw[-1] == 0 and zlib.decompressobj(31).decompress(raw).startswith(b"WARC/1.1")


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if x.isdigit()), "card": 16 <= len(d) <= 19 and _luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_and_terms(spark):
    texts = ["a@b.c_d@e.f x..@a-.b--.c", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111-1111 1111 " + "1" * 9000, "+1 (234) 567-89 +1........ +49 30 12 34 56 78", None, "", "é" * 9 + " é@x.com 😀 +1 2345678 4111111111111111😀", "a" * 50_000 + "@"]
    texts += [f"word{i} Zorblatt wrote jo@x.org about item{i}" for i in range(4)] + ["nothing here"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(",".join(base(t)).encode()).hexdigest()
    for i in range(8, 12):
        spans = {texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[i].spans.split(",")}
        assert {"jo@x.org", "Zorblatt"} <= spans
    assert got[8].n_term > 0 and got[13].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "Zorblatt" not in clean[8] and "<EMAIL>" in clean[8] and clean[13] == "nothing here" and clean[4] is None


def test_pii_terms_in_whole_texts_and_other_texts(spark):
    fill = " ".join(f"w{j}" for j in range(60))
    texts = [fill] * 100 + [f"Quixel {fill} jo@x.org {fill} quixel quixel quixel", f"{fill} Quixel {fill}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert [got[i].n_term for i in (0, 100, 101)] == [0, 4, 1]
    assert clean[100] == f"<TERM> {fill} <EMAIL> {fill} <TERM> <TERM> <TERM>" and clean[101] == f"{fill} <TERM> {fill}" and clean[0] == fill


def _plain(text):
    spans = [tuple(map(int, x.split(":")[1:])) for x in base(text)]
    return "".join(" " if any(a <= i < b for a, b in spans) else c for i, c in enumerate(text))


def _masked(texts):
    """The texts sanitised by the definition: terms of the module docstring, overlapping spans under the name of the first."""
    words = [re.findall("[0-9A-Za-z\x80-\U0010ffff]+", _plain(t)) for t in texts]
    lists = [[x.lower() for x in w] for w in words]
    own = [{(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])].lower()) for x in base(t)} for t in texts]
    in_texts = defaultdict(set)
    for t, w in zip(texts, lists, strict=True):
        for x in w:
            in_texts[x].add(t)
    n_t, n_e, n_et = Counter(), Counter(), Counter()
    for t, w, es in zip(texts, lists, own, strict=True):
        weight = Counter(w)
        if es:
            new = sum(len(in_texts[x]) == 1 for x in w) / max(1, len(w))
            near = set()
            for a, b in ((int(x.split(":")[1]), int(x.split(":")[2])) for x in base(t)):
                cut = _plain(t)
                marked = "".join("\x01" if any(int(s.split(":")[1]) <= i < int(s.split(":")[2]) for s in base(t)) else c for i, c in enumerate(t))
                before, after = marked[:a].split("\x01")[-1], marked[b:].split("\x01")[0]
                find = lambda p: [x.lower() for x in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", p)]
                near |= {*find(before)[-pii.REACH :], *find(after)[: pii.REACH]}
                assert len(cut) == len(t)
            weight = Counter({x: k * (1 - new) + pii.BESIDE * (x in near) for x, k in weight.items()})
        for x, k in weight.items():
            n_t[x] += k
        for e in es:
            n_e[e] += len(w)
            for x, k in weight.items():
                n_et[e, x] += k
    n, left = sum(map(len, lists)), defaultdict(lambda: math.inf)
    for (e, x), both in n_et.items():
        share = both / (n_t[x] + pii.PRIOR)
        if 0 < n_e[e] / n < min(1, share):
            left[x] = min(left[x], -math.log2(share))
    out = []
    for t in texts:
        plain = _plain(t)
        spans = [(int(a), -int(b), pii.KINDS.index(k), f"<{k.upper()}>") for k, a, b in (x.split(":") for x in base(t))]
        for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", plain):
            if left[m[0].lower()] <= pii.GENERALISE:
                removed = left[m[0].lower()] <= pii.REMOVE
                spans.append((m.start(), -m.end(), 4 + removed, "" if removed else "<TERM>"))
        at, new = 0, []
        for a, b, _, name in sorted(spans):
            if a >= at:
                new += [t[at:a], name]
            at = max(at, -b)
        out.append("".join(new) + t[at:])
    return out


def test_pii_sanitises_as_the_definition_says(spark):
    rng = np.random.default_rng(11)
    common, rare, mails = [f"w{i}" for i in range(30)], [f"Rare{i}" for i in range(40)], [f"p{i}@x.org" for i in range(12)] + ["10.0.0.7", "+49 30 1234567"]
    texts = []
    for i in range(150):
        t = rng.choice(common, int(rng.integers(1, 40))).tolist()
        if i % 3 == 0:
            who = int(rng.integers(len(mails)))
            t[int(rng.integers(len(t)))] = mails[who]
            t += [rare[2 * who]] * int(rng.integers(0, 7))
        t += rng.choice(rare, int(rng.integers(0, 2))).tolist()
        texts.append(" ".join(t))
    texts += [texts[0], texts[3], "", "é 😀 " + mails[0], mails[0] + "," + mails[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("own") for c in ("row", "_may", "text_hash", "general", "_id", "base")})
    got = sorted((r.doc_id, r.text, r.row, r._may, r._id) for r in pii.sanitise(docs).collect())
    want = _masked(texts)
    assert [x[1] for x in got] == want and {x[2:] for x in got} == {("own", "own", "own")}
    assert sum("<TERM>" in x for x in want) > 5 and sum(x == t for x, t in zip(want, texts, strict=True)) > 20
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0


def test_pii_of_very_long_texts(spark):
    many = " ".join(f"user{i}@host{i % 977}.org" for i in range(50_000))
    strange = " ".join(f"q{i % 24_000}z" for i in range(100_000)) + " lone@x.org " + " ".join(f"q{i % 24_000}z" for i in range(100_000))
    docs = spark.createDataFrame([(1, many), (2, strange), (3, "plain words here " * 150_000), (4, "Xanthippe Quuxley wrote from a@b.org")], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    began = time.monotonic()
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[1].n_email == 50_000 and got[1].base_sha256 == hashlib.sha256(",".join(base(many)).encode()).hexdigest()
    assert got[3].n_term == 0
    # all words of text 2 are new to the corpus, so newness tells nothing: only what stands beside the address goes
    assert got[2].n_email == 1 and 0 < got[2].n_term <= 10 * 10
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 50_000)
    assert "lone@x.org" not in clean[2] and clean[2].count("<TERM>") == got[2].n_term
    assert "Xanthippe" not in clean[4] and "Quuxley" not in clean[4] and "a@b.org" not in clean[4]
    assert time.monotonic() - began < 120


def test_pii_terms_by_both_joins(spark, monkeypatch):
    texts = [f"zorb{i} wrote jo{i}@x.org of zorb{i} zorb{i} zorb{i} {'plain words ' * 20}" for i in range(60)] + [f"zorb{i} alone" for i in range(60)] + ["plain words"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(pii.find(docs).collect())
    called, sieve = [], pii._sieve
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(pii, "_sieve", lambda *a: called.append(1) or sieve(*a))
    assert sorted(pii.find(docs).collect()) == want and called and sum(r.n_term > 0 for r in want) >= 60


def test_decontamination_by_both_joins(spark, monkeypatch):
    w = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, "x " + w.upper() + " y"), (1, "x " + w.upper() + " y"), (2, "Hi!"), (3, None), (4, ""), (None, w[:20]), (5, "É hi é")], "doc_id long, text string").withColumn("n_hit", F.lit(9))
    bench = spark.createDataFrame([(7, w), (8, "hi"), (9, ""), (10, None), (11, "é")], "item_id long, text string")
    want = {1: (16, 14, 1), 2: (1, 1, 1), 3: (0, 0, 0), 4: (0, 0, 0), 5: (3, 2, 2)}
    for bound in (100_000, 2):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        got = decontaminate.contamination(docs, bench).collect()
        assert len(got) == 7 and {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got if r.doc_id} == want
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, bench).count() == 3


def test_url_rules_and_model(spark):
    urls = [f"http://a{i}.org/x{i}" for i in range(40)] + [f"https://b{i}.Com/de/{i}" for i in range(40)] + ["http://x.example.org/es/1?q", "noscheme", None, "http://good.net/x1", "://", "http://org", "http://a.org?q/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("score", F.lit(1))
    got = urlfilter.judge(pages).collect()
    assert len(got) == len(urls) + 1
    by = {r.page_id: r for r in got}
    assert by[80].rule == "example.org/es/" and by[80].verdict == "block" and by[0].rule == "org/" and by[45].rule == "com/de/" and by[45].host == "b5.com"
    assert by[81].host == "" and by[82].path == "" and by[86].rule is None and {r.verdict for r in got} <= {"allow", "block"}
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_model_keeps_digits_scripts_and_context(spark):
    urls = [f"http://h{i}.org/v{i}-2x" for i in range(200)] + [f"http://h{i}.com/de/v{i}-1x" for i in range(200)]
    urls += [f"http://h{i}.org/{i}/мир" for i in range(200)] + [f"http://h{i}.com/de/{i}/日本語" for i in range(200)]
    ask = ["http://h7.net/v7-2x", "http://h7.net/v7-1x", "http://h7.net/7/мир", "http://h7.net/7/日本語"]
    pages = spark.createDataFrame(list(enumerate(urls + ask)), "page_id long, url string")
    by = {r.page_id: r.score for r in urlfilter.judge(pages).collect()}
    assert by[800] > by[801] and by[802] > by[803] and len(by) == 804


def _components(docs):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(fold))
        sets.append({tuple(w[a : a + 4]) for a in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 85 * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], d)
    return {d: (len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)}


def _url_scores(urls):
    """Scores and verdicts of distinct URLs by the definition: Witten-Bell models of the labelled URLs that aren't kept out."""
    sides, rule = {"allow": Counter(), "block": Counter()}, {}
    grams = lambda u: [("\x02" * 5 + u + "\x03")[i : i + 6] for i in range(len(u) + 1)]
    for u in urls:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), -i, v) for i, (v, h, p) in enumerate(urlfilter.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule[u] = max(fits)[2] if fits else None
        if rule[u] and zlib.crc32(u.encode()) % 5:
            sides[rule[u]].update(grams(u))
    alphabet = {g[-1] for u in urls for g in grams(u)}
    count = {s: Counter() for s in sides}
    for s, c in sides.items():
        for g, n in c.items():
            for k in range(6):
                count[s][g[5 - k :]] += n

    def p(side, gram, k):
        if k < 0:
            return 1 / (len(alphabet) + 1)
        context = gram[5 - k : 5]
        after = [count[side][context + x] for x in alphabet]
        total = sum(after) + sum(n > 0 for n in after)
        below = p(side, gram, k - 1)
        return (count[side][gram[5 - k :]] + sum(n > 0 for n in after) * below) / total if total else below

    score = {u: float(np.mean([math.log(p("allow", g, 5)) - math.log(p("block", g, 5)) for g in grams(u)])) for u in set(urls)}
    return score, rule


def test_url_model_against_brute_force(spark):
    rng = np.random.default_rng(8)
    part = lambda: "".join(rng.choice(list("abcé1"), int(rng.integers(1, 6))))
    urls = [f"http://{part()}.{t}" for t in ("org/" + part() for _ in range(30))] + [f"http://{part()}.com/de/{part()}" for _ in range(30)] + [f"http://{part()}.net/{part()}" for _ in range(30)] + ["", "x"]
    urls += urls[:3] + urls[60:62]
    score, rule = _url_scores(urls)
    held = [u for u in urls if rule[u] and zlib.crc32(u.encode()) % 5 == 0]
    step = 2.0 / urlfilter.BINS
    place = lambda u: math.floor(round(score[u], 9) / step)
    good, bad = [[place(u) for u in held if rule[u] == v] for v in ("allow", "block")]
    assert good and bad
    best = max((sum(b >= t for b in good) / len(good) + 1 - sum(b >= t for b in bad) / len(bad), -abs(t), t) for t in {*good, *bad})[2] * step
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        u = urls[r.page_id]
        assert abs(r.score - score[u]) < 1e-7 and r.verdict == (rule[u] or ("allow" if round(score[u], 9) >= best else "block"))


def test_a_very_long_url_ends(spark):
    urls = [f"http://a{i}.org/x" for i in range(9)] + [f"http://a{i}.com/de/" for i in range(9)] + ["http://a.net/" + "xyz1" * 75_000]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert len(got) == 19 and len(max(r.path for r in got)) >= 2


def _languages(rows, texts):
    """Languages by the definition, with sets in place of filters."""
    def grams(t):
        b = re.sub(rb"[^a-z\x80-\xff]+", b" ", t.lower().encode() if t.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()))
        return [b[i : i + 4] for i in range(len(b) - 3)]

    counts = defaultdict(Counter)
    for t, lang in rows:
        counts[lang].update(grams(t))
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    best, seen = Counter(), Counter()
    for x, c in counts.items():
        seen.update(c)
        for g in c:
            best[g] = max(best[g], rate[x][g])
    held = {x: {g for g in c if seen[g] >= langid.LEAST and rate[x][g] >= langid.SHARE * best[g] and rate[x][g] * langid.MEMBERS >= 1} for x, c in counts.items()}
    return [max(sorted(held), key=lambda x: sum(g in held[x] for g in grams(t))) for t in texts]


def test_languages_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").dropna(subset=["text", "lang"])
    learn = docs[[zlib.crc32(str(d).encode()) % 4 != 2 for d in docs.doc_id]]
    want = dict(zip(docs.doc_id, _languages(list(zip(learn.text, learn.lang, strict=True)), docs.text), strict=True))
    got = {r.doc_id: r for r in langid.op9_language_id(spark, SF).collect()}
    assert np.mean([got[d].lang_pred == x for d, x in want.items()]) >= 0.99
    held = [(got[d].lang_pred, x) for d, x in zip(docs.doc_id, docs.lang, strict=True) if got[d].held_out]
    assert np.mean([a == b for a, b in held]) >= 0.98


def test_toxicity_weights_and_extremes_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}x" for i in range(30)]
    texts = [" ".join([*rng.choice(words, 30), *(["vile"] * (i % 5 == 0))]) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id long, toxic int"))
    n, y = Counter(w for t in texts for w in t.split()), [Counter(w for i, t in enumerate(texts) if (i % 5 == 0) == k for w in t.split()) for k in (False, True)]
    for w in [*words, "vile"]:
        _, own, _ = toxicity.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
        prior = toxicity.FLOOR + toxicity.PRIOR * n[w] / sum(n.values())
        a0, a1 = y[0][w] + prior, y[1][w] + prior
        raw = math.log(a1 / (sum(y[1].values()) + toxicity.PRIOR)) - math.log(a0 / (sum(y[0].values()) + toxicity.PRIOR))
        want = math.copysign(max(0.0, abs(raw) - toxicity.SHRINK * math.sqrt(1 / a0 + 1 / a1)), raw)
        assert abs(model["weights"][own[0]] - want) < 1e-5
    best, length = np.where(rng.random(300) < 0.3, 0.0, rng.gumbel(1.0, 0.7, 300).clip(0.01)), rng.integers(5, 80, 300).astype(float)
    s, m = np.append(best, 1.0), np.append(length, length.mean())

    def likelihood(lam, k):
        return ((s > 0) * (math.log(k) + np.log(m) + math.log(lam) - lam * s)).sum() - (k * m * np.exp(-lam * s)).sum()

    lam, k = toxicity.extreme_value(best, length)
    assert all(likelihood(lam, k) >= likelihood(lam * a, k * b) for a in (0.97, 1.0, 1.03) for b in (0.97, 1.0, 1.03))


def _toxicity_by_definition(texts, labels, folds):
    """Scores from counts of whole words and stems by name, all segments by search, and the two fits; labels and folds by place of the text."""
    split = [re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t or "") for t in texts]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws] for ws in split]
    forms = lambda w: (("own", w), ("stem", w[: toxicity.STEM]))
    n, by = Counter(), {k: Counter() for k in range(4)}
    total, sums = 0, Counter()
    for i, ws in enumerate(words):
        for w in ws:
            n.update(forms(w))
            total += 1
            if i in labels:
                by[labels[i] + folds[i]].update(forms(w))
                sums[labels[i] + folds[i]] += 1

    def odds(form, kinds):
        all0, all1 = sum(sums[k] for k in kinds[0]), sum(sums[k] for k in kinds[1])
        if not all0 or not all1:
            return 0.0
        prior = toxicity.FLOOR + toxicity.PRIOR * n[form] / total
        a0, a1 = (sum(by[k][form] for k in own) + prior for own in kinds)
        raw = math.log(a1 / (all1 + toxicity.PRIOR)) - math.log(a0 / (all0 + toxicity.PRIOR))
        return math.copysign(max(0.0, abs(raw) - toxicity.SHRINK * math.sqrt(1 / a0 + 1 / a1)), raw)

    def scored(ws, kinds):
        each = [[odds(f, kinds) for f in forms(w)] for w in ws]
        return [min(6.0, max(-4.0, (stem if abs(stem) > abs(own) else own) - toxicity.DRIFT)) for own, stem in each]

    sums_of = lambda ws, kinds: [x[2] for x in _all_segments(scored(ws, kinds))]
    trial, final = ((0,), (1,)), ((0, 2), (1, 3))
    held = [i for i in labels if folds[i] == 2]
    found = {i: sums_of(words[i], trial) for i in held}
    clean = [i for i in held if labels[i] == 0]
    model = {}
    model["lambda"], model["k"] = toxicity.extreme_value(np.array([max(found[i], default=0.0) for i in clean]), np.array([float(len(words[i])) for i in clean]))

    def evidence(length, each):
        if not each or not length:
            return -2.0
        e = [(model["lambda"] * s - math.log(model["k"] * length)) / math.log(10) for s in each]
        strong = [x for x in e if x >= -math.log10(toxicity.SIGNIFICANT)]
        return min(30.0, max(-2.0, sum(strong) if strong else max(e)))

    slope, centre = toxicity._logistic(np.array([evidence(len(words[i]), found[i]) for i in held]), np.array([labels[i] == 1 for i in held]))
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, slope * (evidence(len(ws), sums_of(ws, final)) - centre))))) for ws in words]


def test_toxicity_scores_by_definition(spark):
    rng = np.random.default_rng(21)
    plain, bad = [f"wo{i}rd" for i in range(25)], ["vile", "vilest", "Vilely", "räudig", "awful"]
    texts = []
    for i in range(180):
        t = rng.choice(plain, int(rng.integers(0, 30))).tolist()
        if i % 4 == 0:
            at = int(rng.integers(len(t) + 1))
            t[at:at] = rng.choice(bad, int(rng.integers(1, 5))).tolist()
        texts.append(", ".join(t))
    texts += ["", None, texts[4], "Vile vile vile!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {i: int(i % 4 == 0) for i in range(150)}
    table = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    fold = F.when(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(toxicity.FOLDS)) == 0, 2).otherwise(0)
    folds = {r.doc_id: r.f for r in table.select("doc_id", fold.alias("f")).collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, table)).collect()}
    want = _toxicity_by_definition(texts, labels, folds)
    assert all(abs(got[i] - p) < 1e-3 for i, p in enumerate(want))
    assert max(want) > 0.9 and min(want) < 0.1


def _copies(rng, words, sizes, most_edits):
    """Texts in groups: a text of each size and copies of it with up to most_edits words replaced."""
    for size, copies in sizes:
        first = rng.choice(words, size).tolist()
        for _ in range(copies):
            t = list(first)
            for _ in range(int(rng.integers(0, most_edits))):
                t[int(rng.integers(len(t)))] = f"z{int(rng.integers(1000))}"
            yield " ".join(t)


@pytest.mark.parametrize("caps", [(jaccard.MOST_NODES, jaccard.MOST_SHINGLES), (5, 1 << 20), (100, 300)])
def test_jaccard_components(spark, caps):
    rng = np.random.default_rng(caps[0])
    words = np.array([f"w{i}" for i in range(400)])
    docs = list(enumerate(_copies(rng, words, [(int(rng.integers(3, 120)), 12) for _ in range(6)], 5)))
    docs += [(900, None), (901, ""), (902, " \t"), (903, "ONE two"), (904, "one TWO"), (905, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "key", "gid", "comp", "n", "set")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, caps=caps).collect()}
    assert got == _components(docs)
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("caps", [(jaccard.MOST_NODES, jaccard.MOST_SHINGLES), (60, 1 << 20)])
def test_jaccard_on_one_large_group_of_near_copies(spark, caps):
    """Links are a small part of the pairs of this group, and neither its cells nor its regions fit the small caps."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(400)])
    docs = list(enumerate(_copies(rng, words, [(60, 300), (30, 20)], 9)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), caps=caps).collect()}
    assert got == _components(docs)


def test_voronoi_windows_lose_no_link():
    """Points of a line: every pair within r shares a region."""
    rng = np.random.default_rng(5)
    points, pivots, r = rng.random(200), rng.random(7), 0.05
    home, inside = jaccard.regions_of(np.abs(points[:, None] - pivots[None, :]), r)
    together = (inside[:, None, :] & inside[None, :, :]).any(2)
    assert together[np.abs(points[:, None] - points[None, :]) <= r].all()
    assert not together.all() and (inside[np.arange(200), home]).all()


@pytest.mark.parametrize("asked", [topk.ASKED, 2])
def test_top_k_against_brute_force(spark, monkeypatch, asked):
    monkeypatch.setattr(topk, "ASKED", asked)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(400, None), (401, [1.0, None, 2.0, 3.0]), (402, [float("nan")] * 4), (None, [1.0] * 4), (500, [0.5] * 4), (501, [0.5] * 4), (600, [1.0] * 3), (601, [2.0] * 3), (700, []), (701, [])]
    rows += [(1000 + i, [3.0, 3.0, 3.0, 3.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {i: np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (x for x in good if x % 100 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    twice = df.union(df.where("vec_id = 200"))
    assert sum(r.query_id == 200 for r in topk.top_k(twice).collect()) == 20
    assert topk.top_k(df.limit(0)).count() == 0


def test_language_id(spark):
    de, en = "der schnelle braune fuchs springt über den faulen hund ", "the quick brown fox jumps over the lazy dog "
    rows = [(i, (de, en)[i % 2] * (1 + i % 3), ("de", "en")[i % 2], None, 1) for i in range(40)] + [(90, None, None, None, 0), (91, "12 !", "en", None, 1), (92, "", None, None, 0), (93, "über den hund", None, None, 1)]
    docs = spark.createDataFrame(rows, DOC).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert got[0].lang_pred == "de" and got[1].lang_pred == "en" and got[93].lang_pred == "de"
    assert all(got[i].lang_pred == "und" for i in (90, 91, 92)) and all(0 <= r.score <= 1 for r in got.values())
    assert langid.keep_identified(docs).count() == 41
    assert langid.identify(docs, langid.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def _all_segments(score):
    """Maximal scoring segments by their recursive definition."""
    if not len(score) or max(score) <= 0:
        return []
    best = max(((sum(score[a:b]), -(b - a), a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), key=lambda x: (x[0], x[1]))
    _, _, a, b = best
    return _all_segments(score[:a]) + [(a, b, sum(score[a:b]))] + [(b + x, b + y, s) for x, y, s in _all_segments(score[b:])]


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(200):
        score = rng.normal(-0.2, 1, int(rng.integers(0, 14)))
        got, want = toxicity.segments(score), _all_segments(score.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(50)], 40)) + (" awful vile" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i].score >= 0.7) == (i % 4 == 0) for i in range(300, 400)) and got[300].passages and got[900].score < 0.7
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).where("score > 0").count() == 0


def test_token_rollup_is_idempotent(spark, tmp_path):
    def change(*rows):
        return spark.createDataFrame([(*r[:2], "t", *r[2:]) for r in rows], "op string, doc_id long, tokenizer string, source string, lang string, tokens long")

    r = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    first = change(("insert", 1, "a", "en", 10), ("insert", 2, "a", "en", 5), ("insert", 3, None, None, 7))
    assert r.commit("1", first) and not r.commit("1", first)
    r.commit("2", change(("delete", 2, None, None, None), ("delete", 9, None, None, None), ("revise", 1, "b", "en", 12)))
    assert not r.commit("2", change(("delete", 1, None, None, None)))
    assert {tuple(x) for x in r.totals().collect()} == {("b", "en", "t", 1, 12), (None, None, "t", 1, 7)}
    with pytest.raises(ValueError):
        r.commit("0", first)


def test_token_rollup_keeps_every_row_and_compacts(spark, tmp_path, monkeypatch):
    """Rows without id and repeated ids all count; stored ledgers change nothing; against a dictionary."""
    monkeypatch.setattr(tokencounts, "COMPACT", 3)
    rng, r, live = np.random.default_rng(4), tokencounts.Rollup(spark, f"file://{tmp_path}/r"), {}
    for batch in range(8):
        rows = [(str(rng.choice(["insert", "revise", "delete"])), int(i) if i else None, "t", str(rng.choice(["a", "b"])), None, int(rng.integers(0, 9))) for i in rng.integers(0, 7, 5)]
        for doc in {x[1] for x in rows}:
            own = [x for x in rows if x[1] == doc]
            last = max(tokencounts._ORDER.index(x[0]) for x in own)
            live[doc] = [] if last == 2 else [x for x in own if tokencounts._ORDER.index(x[0]) == last]
        changes = spark.createDataFrame([*rows, (None, 1, "t", "a", "x", 99), ("other", 1, "t", "a", "x", 99)], "op string, doc_id long, tokenizer string, source string, lang string, tokens long").withColumns({"rank": F.lit(9), "docs": F.lit(9)})
        assert r.commit(f"{batch:03}", changes)
        want = {s: (sum(x[3] == s for v in live.values() for x in v), sum(x[5] for v in live.values() for x in v if x[3] == s)) for s in "ab"}
        assert {x.source: (x.docs, x.tokens) for x in r.totals().collect()} == {s: v for s, v in want.items() if v[0]}
    assert r._with("whole_ledger") == ["002", "005"]


def test_token_counts_query_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    with open(f"{tokencounts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        encode = tokencounts._encoder("x", f.read(), tokencounts.PATTERN).encode_ordinary
    docs["first"] = docs.groupby("text").doc_id.transform("min")
    docs = docs[docs.doc_id == docs["first"]]
    docs["tokens"] = [len(encode(re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t))) for t in docs.text]
    want = docs.groupby(["source", "lang"]).tokens.agg(["count", "sum"])
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in tokencounts.op2_token_counts(spark, SF).collect()}
    assert got == {k: tuple(v) for k, v in want.iterrows()}


def test_token_counts_of_pieces(spark, monkeypatch):
    with open(f"{tokencounts.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        encode = tokencounts._encoder("x", f.read(), tokencounts.PATTERN).encode_ordinary
    text = "The quick brown fox, isn't it?  Née 12 34. " * 40
    whole = len(encode(text))
    monkeypatch.setattr(tokencounts, "PIECE", 50)
    assert tokencounts.count_tokens(encode, text) == whole


def test_mixing_rates_and_copies(spark):
    docs = spark.createDataFrame([(i, "x" * 10, "en", "s0" if i % 3 else None, 10) for i in range(900)] + [(None, "q", "en", "s1", 1)], DOC).withColumn("copy", F.lit(0))
    weights = spark.createDataFrame([("s0", 1.0), (None, 3.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.replicate(docs, weights).groupBy("source").count().collect()}
    assert "s1" not in n and abs(n[None] / n["s0"] - 3) < 0.5
    big = mixing.replicate(docs.limit(20), total=20 * 10 * 1200.0).count()
    assert abs(big / 20 - 1200) < 60
    assert mixing.replicate(docs.limit(0)).count() == 0


HELPERS = "text_id row _may _id _base _terms _hit _new items w words n n_t n_e pos key hot salt least most node comp gid u v draws cdf drawn who rated lang_pred label t g l rank docs tokens counts at e x plain copies held hash _s payload_digest first body record_id".split()


def _odd_rows():
    """Nulls, an empty, a very long and a wide text, repeated rows, ties."""
    long = "lorem ipsum dolor sit amet " * 40_000
    return [(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "a b c d e", "de", None, None), (None, "a b c d e f", None, "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, long, "la", "s", len(long)), (6, "x@y.zz é 😀 " * 3, "en", "s", 33), (7, "  ", None, "s", 2)]


ON_DOCUMENTS = {
    "tokens": lambda d, b: tokencounts.with_tokens(d),
    "pii": lambda d, b: pii.sanitise(d),
    "contamination": lambda d, b: decontaminate.contamination(d, b),
    "decontaminate": lambda d, b: decontaminate.decontaminate(d, b),
    "mixing": lambda d, b: mixing.shuffled(mixing.replicate(d)),
    "jaccard": lambda d, b: jaccard.keep_one(d),
    "language": lambda d, b: langid.keep_identified(d),
    "identify": lambda d, b: langid.identify(d, langid.train(d)),
    "toxicity": lambda d, b: toxicity.score(d, toxicity.fit(d, d.select("doc_id", F.lit(1).alias("toxic")))),
}
#: Rows of the odd table that each leaves; None where that is drawn.
LEFT = {"tokens": 9, "pii": 9, "contamination": 9, "decontaminate": 5, "mixing": None, "jaccard": 8, "language": 6, "identify": 9, "toxicity": 9}


@pytest.mark.parametrize("name", list(ON_DOCUMENTS))
def test_odd_rows_and_clashing_columns(spark, name):
    """Columns named like helpers come back as they were, from odd rows as from an empty table."""
    docs = spark.createDataFrame(_odd_rows(), DOC).withColumns({c: F.lit(f"own {c}") for c in HELPERS})
    bench = spark.createDataFrame([(1, "A b c D e"), (2, None), (None, "q")], "item_id long, text string").withColumns({c: F.lit(1) for c in ("w", "s", "body", "key")})
    added = {"contamination": {"items_sha256"}, "tokens": {"tokens"}, "identify": {"lang_pred"}}.get(name, set())
    run = ON_DOCUMENTS[name]
    out = run(docs, bench)
    got = out.collect()
    assert LEFT[name] is None or len(got) == LEFT[name]
    same = [c for c in HELPERS if c not in added]
    assert {tuple(r[c] for c in same) for r in got} <= {tuple(f"own {c}" for c in same)} and set(docs.columns) - {"text"} <= set(out.columns)
    assert run(docs.limit(0), bench.limit(0)).count() == 0


@pytest.mark.parametrize("module", [warc, decontaminate, topk, jaccard, mixing])
def test_queries_equal_sql(spark, module):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in module.ORACLE.items():
        got, want = module.QUERIES[name](spark, SF).toPandas(), db.execute(sql).df()
        c = sorted(got.columns)
        key = lambda p, c=c: sorted(tuple("-" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in p[c].itertuples(index=False, name=None))
        assert key(got) == key(want)


def _poisson_copies(docs):
    """Copies of each document by the definition: a Poisson number of its source's mean, inverted at a hash of its id."""
    size = docs.text.str.len().groupby(docs.source).sum()
    mean = size**mixing.FLATTEN / (size**mixing.FLATTEN).sum() * size.sum() / size
    out = {}
    for d, s in zip(docs.doc_id, docs.source, strict=True):
        u = int(hashlib.md5(f"{mixing.SEED}|{d}|1".encode()).hexdigest()[:13], 16) / 2**52
        p = total = math.exp(-mean[s])
        n = 0
        while total <= u:
            n += 1
            p *= mean[s] / n
            total += p
        out[d] = n
    return {d: n for d, n in out.items() if n}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        old = out
        out = spark.createDataFrame(stage(spark, out, SF).toPandas(), docs.schema)
        assert out.columns == docs.columns, name
    old = sorted((r.doc_id, r.text) for r in old.collect())
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(d, t) for (d, _), t in zip(old, _masked([t for _, t in old]), strict=True)]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    mixed = corpus_pipeline.STAGES[4][1](spark, out, SF).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == _poisson_copies(out.toPandas())
    kept = {r.doc_id for r in out.collect()}
    bench = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    bad = {r.doc_id for r in bench.where("contaminated").collect()}
    copies = {d for d, (_, c) in _components(sorted(before.items())).items() if c != d}
    assert kept == set(before) - bad - copies
