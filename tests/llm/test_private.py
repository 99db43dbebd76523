"""Personal data, hard negatives and ranked search against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import hard_negatives, queries, ranked_search, sanitise

# --- personal data ---------------------------------------------------------------------------------------------------------

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def plain_base(text):
    found = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        found += [(m.start(), k, m.end(), m[0]) for m in re.finditer(pattern, text) if passes(kind, m[0])]
    return sorted(found)


def plain_sanitise(texts, alpha, support, window):
    names = list(KINDS)
    base = [plain_base(t or "") for t in texts]
    holding, joint, words = Counter(), Counter(), []
    documents = Counter()
    form = lambda t: t[:3] + "*" if len(t) > 3 else None
    for text, spans in zip(texts, base, strict=True):
        text = text or ""
        units = {w.lower() for w in WORD.findall(text)}
        documents.update(units | {form(u) for u in units if form(u)})
        stretches = []
        for start, kind, stop, value in spans:
            entity = f"{names[kind]}:{value.lower()}"
            if stretches and start < stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], stop)
                stretches[-1][2].add(entity)
            else:
                stretches.append([start, stop, {entity}])
        holding.update({e for s in stretches for e in s[2]})
        mine = []
        for i, (begin, end, entities) in enumerate(stretches):
            floor = stretches[i - 1][1] if i else 0
            ceiling = stretches[i + 1][0] if i + 1 < len(stretches) else len(text)
            for low, high in ((floor, begin), (end, ceiling)):
                for m in WORD.finditer(text, low, high):
                    if m.start() >= begin - window and m.end() <= end + window:
                        mine += [(e, m[0].lower(), m.start(), m.end()) for e in entities]
        words.append(mine)
        joint.update({(e, u) for e, t, _, _ in mine for u in (t, form(t)) if u})
    total = len(texts)

    def too_much(entity, unit):
        if joint[entity, unit] < support or holding[entity] == total:
            return False
        told = math.log2(joint[entity, unit] * total / (holding[entity] * documents[unit])) / math.log2(total / holding[entity])
        return told >= alpha

    made = []
    for spans, mine in zip(base, words, strict=True):
        added = {}
        for entity, term, start, stop in mine:
            if too_much(entity, term):
                kind = 4 if form(term) and not too_much(entity, form(term)) else 5
                added[start, stop] = max(kind, added.get((start, stop), 0))
        made.append((spans, sorted([s[:3] for s in spans] + [(start, kind, stop) for (start, stop), kind in added.items()])))
    return made


def odd_texts():
    rng = random.Random(5)
    secret = "jo.doe+x%1@mail-3.example.com"
    texts = [
        None, "", "no data at all", f"write to {secret} or {secret}", "a@b.c_d@e.f a@b@c.d @x.y x@y x@y. .@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 000255.0.0.0 256.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12 - 34 1", "4111111111111111 41111111111111111111111", "+1 (555) 555-0100 +1 555 +12345678901234567 +1((((((( ++49 30 1234567",
        "9" * 20_000, "x" * 30_000 + " y", "1." * 5_000, "a@" * 2_000, "zoë 😀😀 " + secret + " 😀 café +49 30 123456-78é", "+1 4111 1111 1111 1111 call",
        "card 4111 1111 1111 1111, 4111-1111-1111-1112.", "long " * 20_000 + "10.0.0.1", "q@r.st" * 40, "Ⅷ١٢٣ ａ@b.c ١.٢.٣.٤",
    ]
    for i in range(60):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta brunch".split()) for _ in range(rng.randint(0, 30))]
        if i % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = ["Brunhild" if i % 12 else "Brunswick", secret, "Zyx"]
        if i % 9 == 0:
            words += ["+1 (555) 555-0100", "Wilhelmina"]
        texts.append(" ".join(words))
    return texts + [texts[3], texts[3], texts[18]]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sanitise_by_brute_force(spark):
    texts = odd_texts()
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(3)
    got = {r["doc_id"]: r for r in sanitise.sanitise(df, alpha=0.6, window=40, keep_text=True).collect()}
    want = plain_sanitise(texts, 0.6, 2, 40)
    assert len(got) == len(texts)
    kinds = set()
    for i, (base, spans) in enumerate(want):
        assert [tuple(s) for s in got[i]["base"]] == base, texts[i]
        assert [(s["start"], s["kind"], s["stop"]) for s in got[i]["spans"]] == spans, texts[i]
        kinds |= {s[1] for s in spans}
        for _, _, _, value in base:
            assert value not in got[i]["sanitised"]
        if not spans:
            assert got[i]["sanitised"] == (texts[i] or "")
    assert kinds == set(range(6))


def test_sanitise_judges_all_words_of_a_document(spark):
    """A word far away, and behind another value, gives a value away like one next to it; forms count rare words too."""
    filler = " ".join(["and so on"] * 60)
    texts = [f"zanzibar {filler} {i}@x.org {filler} a.b@mail.org {filler} volcano{'' if i % 2 else 'es'}" for i in range(4)] + [f"{filler} plain {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in ({}, {"window": 100}):
        got = {r["doc_id"]: r for r in sanitise.sanitise(df, keep_text=True, **how).collect()}
        assert len(got) == len(texts)
        for i in range(4):
            spans = {texts[i][s["start"] : s["stop"]] for s in got[i]["spans"] if s["kind"] >= sanitise.GENERALISE}
            assert spans == ({"zanzibar", "volcano" if i % 2 else "volcanoes"} if not how else set())
            assert "a.b@mail.org" not in got[i]["sanitised"] and ("zanzibar" in got[i]["sanitised"]) == bool(how)


def test_sanitise_odd_tables(spark):
    assert sanitise.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = spark.createDataFrame([(None, "a@b.cd x"), (1, "a@b.cd x"), (1, "a@b.cd x")], "doc_id long, text string")
    assert sanitise.sanitise(same).where(F.size("spans") == 1).count() == 3  # the entity stands everywhere


def test_op11_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in queries.read(spark, sf, "documents").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op11_pii(spark, sf).collect()}
    want = dict(zip(texts, plain_sanitise(list(texts.values()), 0.75, 2, 100), strict=True))
    names = [*KINDS, "generalise", "remove"]
    for key, (base, spans) in want.items():
        row = got[key]
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert row["base_sha256"] == digest(",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in base))
        assert row["spans"] == ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def test_op11_has_no_python_in_its_plan(spark):
    plan = sanitise.sanitise(queries.read(spark, "/root/testdata/sf0.001", "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- hard negatives --------------------------------------------------------------------------------------------------------


def plain_negatives(rows, positives, negatives):
    kept = []
    for key, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((key, i, [math.floor(256 * x) for x in vector], label))
    made = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for key, i, vector, label in kept:
        if i is None or i % 10:
            continue
        scores = [(sum(a * b for a, b in zip(vector, v, strict=False)), j, lab == label) for k, j, v, lab in kept if k != key]
        best = sorted([s for s in scores if s[2]], key=order)[:positives]
        for score, j, _ in best:
            window = sorted([s for s in scores if not s[2] and 30 * score <= 100 * s[0] <= 90 * score], key=order)[:negatives]
            made += [(i, j, rank + 1, s[1], score, s[0]) for rank, s in enumerate(window)]
    return sorted(made, key=str)


@pytest.mark.parametrize("width,spread", [(3, 1.0), (64, 0.2), (150, 300.0), (0, 1.0)])
def test_hard_negatives(spark, width, spread):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, spread) + spread for _ in range(width)], rng.choice([0, 0, 0, 1, 2])) for i in range(120)]
    rows += [(200 + i, list(rows[7][1]), 1) for i in range(30)] + [rows[10], rows[10], rows[11]]
    rows += [(None, list(rows[3][1]), 0), (None, list(rows[4][1]), 1), (300, None, 0), (301, rows[3][1], None)]
    rows += [(310, [math.nan] * width + [math.nan], 0), (320, [math.inf] + rows[0][1], 1), (330, [None], 0), (340, rows[0][1][:2], 0), (350, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, q string, size double").repartition(5)
    made = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, positives=4, negatives=6)
    assert sorted([tuple(r) for r in made.collect()], key=str) == plain_negatives(rows, 4, 6)


def test_scores_are_exact(monkeypatch):
    rng = np.random.default_rng(1)
    for reach, width in ((1, 1), (255, 64), (70_000, 64), (1 << 24, 200), (1 << 22, 1000)):
        left, right = (rng.integers(-reach, reach + 1, (7, width)) for _ in range(2))
        bound = int(max((left**2).sum(1).max(), (right**2).sum(1).max()))
        primes = hard_negatives.moduli(bound, width)
        got = hard_negatives.exact_scores(hard_negatives.residues(left, primes), hard_negatives.residues(right, primes), primes)
        assert (got == left @ right.T).all()
        assert all(x.dtype == np.float32 for x in hard_negatives.residues(left, primes))


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0.1, 0.3) for _ in range(8)], rng.choice([0, 0, 1])) for i in range(300)]
    for name, value in (("BLOCK", 4), ("TILE", 16), ("STEP", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    made = hard_negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0, positives=3, negatives=5)
    assert sorted([tuple(r) for r in made.collect()], key=str) == plain_negatives(rows, 3, 5)


def test_hard_negatives_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 10 == 0).count() == 0


# --- ranked search ---------------------------------------------------------------------------------------------------------


def plain_search(docs, asked, k):
    terms = lambda t: [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORD.findall(t or "")]
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    made = []
    for item, text in asked:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            scores.append((score, i))
        scores = sorted([s for s in scores if s[0] > 0], key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        made += [(item, rank + 1, i, score) for rank, (score, i) in enumerate(scores)]
    return sorted(made, key=str)


def plain_tables():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Été", "ÉTÉ", "x1", "naïve", "日本", "a-b", "Zeta"] + [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.1)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, draw(rng.choice([1, 5, 20, 60]))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(150)] + [(None, docs[5][1]), (7, docs[8][1]), (7, draw(9)), (500, None), (501, ""), (502, "-- \x00\x7f --")]
    docs += [(503, draw(20_000))]
    asked = [(i, draw(12)) for i in range(12)] + [(50, None), (51, ""), (52, "absent words"), (53, docs[5][1]), (None, "w1 w1 w2"), (53, "the THE"), (54, draw(3_000))]
    return docs, asked


def test_ranked_search(spark, monkeypatch):
    docs, asked = plain_tables()
    want = plain_search(docs, asked, 10)
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, terms string").repartition(3)
    right = spark.createDataFrame([(*q, 2) for q in asked], "item_id long, text string, doc_id int")
    for stretch, entries, terms in ((64, 1_000_000, 200_000), (1, 300, 20)):
        for name, value in (("STRETCH", stretch), ("ENTRIES", entries)):
            monkeypatch.setattr(ranked_search, name, value)
        got = ranked_search.search(left, right, k=10, terms=terms)
        assert sorted([tuple(r) for r in got.collect()], key=str) == want


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    document, term = np.tile(np.arange(5000), 2), np.repeat([0, 1], 5000)
    impact = np.concatenate([rng.permutation(5000), np.ones(5000, dtype=np.int64)])
    shard = ranked_search.Shard(document, term, impact, 5000, 2)
    read = defaultdict(int)

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                read["entries"] += key.stop - key.start
            return super().__getitem__(key)

    shard.document = shard.document.view(Counted)
    at, score = shard.search([(0, 1)], np.arange(5000), 10, 1)
    assert sorted(score.tolist()) == list(range(4990, 5000)) and len(at) == 10
    assert read["entries"] == ranked_search.STRETCH


def test_ranked_search_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, asked).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ranked_search.search(some, asked.where("item_id > 1")).count() == 0
