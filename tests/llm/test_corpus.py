"""Suffix order, repeats, decontamination, back-off scores, page text, quality and the pipeline against brute force."""

import bisect
import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontaminate, html_extract, lm_scoring, quality, queries, suffix_dedup
from tablewright.llm.common import components
from tablewright.llm.suffix_order import suffix_ranks

# --- suffixes --------------------------------------------------------------------------------------------------------------


def test_suffix_ranks(spark):
    rng = random.Random(3)
    runs = [(i, [rng.choice([1, 2, 9]) for _ in range(rng.choice([1, 2, 3, 4, 5, 20]))]) for i in range(20)]
    runs += [(30 + k, [5] * k) for k in (1, 2, 3, 10, 11, 12)] + [(50, list(runs[3][1]))]
    df = spark.createDataFrame([(r, s, [1] * len(s)) for r, s in runs], "run long, s array<long>, w array<long>")
    got = {r["run"]: list(r["ranks"]) for r in suffix_ranks(df).collect()}
    suffixes = sorted(tuple(s[i:]) for _, s in runs for i in range(len(s)))
    assert got == {r: [1 + bisect.bisect_left(suffixes, tuple(s[i:])) for i in range(len(s))] for r, s in runs}


def plain_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    found = []
    for raw in raws:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for i in range(len(raw)) if covered[i] and not (i and covered[i - 1]))
        found.append((len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_by_every_byte(spark, seed):
    rng, length = random.Random(seed), 48
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    texts = [word(rng.randint(0, 8 * length)) for _ in range(40)]
    for _ in range(80):
        source, k = rng.choice(texts), rng.randrange(len(texts))
        i, j = rng.randrange(len(source) + 1), rng.randrange(len(texts[k]) + 1)
        texts[k] = texts[k][:j] + source[i : i + rng.randint(length // 2, 3 * length)] + texts[k][j:]
    for _ in range(10):
        near = list(rng.choice(texts) or "x")
        near[rng.randrange(len(near))] = "#"
        texts.append("".join(near))
    texts += [texts[3], texts[3], None, "", None, "a" * (3 * length), "ab" * (2 * length), "a" * length, "b" * (length + 1)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_removed int")
    got = suffix_dedup.remove_repeats(df, length=length)
    rows = {r["doc_id"]: r for r in got.collect()}
    want = plain_repeats(texts, length)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in rows.items()} == dict(enumerate(want))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows.values())
    assert all(sum(s["to"] - s["from"] for s in r["spans"]) == r["n_removed"] for r in rows.values())


def test_repeats_of_an_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in label.items() if n in linked}


# --- decontamination -------------------------------------------------------------------------------------------------------


def test_leaks_by_every_window(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate((3, 12, 30, 30, 60, 5))} | {6: ["rep"] * 20}
    docs = {}
    for d in range(40):
        body, item = text(rng.randrange(80)), list(items[rng.randrange(7)])
        for _ in range(rng.randrange(3)):
            at = rng.choice([0, len(item) - 1, rng.randrange(len(item))])
            item[at : at + 1] = rng.choice([["new"], [], [item[at], "more"]]) if len(item) > 1 else ["x"]
        at = rng.randrange(len(body) + 1)
        docs[d] = body[:at] + [w.upper() + "!" for w in item] + body[at:]
    want = {}
    for d, body in docs.items():
        body = [w.lower().rstrip("!") for w in body]
        for i, item in items.items():
            k = min(5, len(item))
            shingles = lambda w, k=k: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            a, best = shingles(item), None
            for s in range(max(1, len(body) - len(item) + 1)):
                b = shingles(body[s : s + len(item)])
                both = (a & b).total()
                alike = both / (a.total() + b.total() - both)
                if alike >= 0.8 and (best is None or alike > best):
                    best = alike
            if best:
                want[d, i] = best
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()] + [(90, None), (91, ""), (0, " ".join(docs[0]))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(8, None), (9, " ,")], "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == pytest.approx(want)
    assert len(got) == len(want) + sum(1 for d, _ in want if d == 0)
    none = spark.createDataFrame([], df.schema)
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(df, spark.createDataFrame([], bench.schema)).count() == 0


def test_leaks_with_parts_in_another_order(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate((40, 60, 100, 100))}
    filler = lambda: [f"x{rng.randrange(10**6)}" for _ in range(120)]
    docs = {}
    for i, item in items.items():
        for cut, between in ((len(item) // 2, 0), (len(item) // 3, 0), (len(item) // 2, 1)):
            docs[len(docs)] = (i, [*filler(), *item[cut:], *[f"y{j}" for j in range(between)], *item[:cut], *filler()])
    shingles = lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    want = {}
    for d, (i, body) in docs.items():
        a, best = shingles(items[i]), 0.0
        for s in range(len(body) - len(items[i]) + 1):
            both = (a & (b := shingles(body[s : s + len(items[i])]))).total()
            best = max(best, both / (a.total() + b.total() - both))
        if best >= 0.8:
            want[d, i] = best
    assert len(want) >= 10
    df = spark.createDataFrame([(d, " ".join(body)) for d, (_, body) in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == pytest.approx(want)


def test_index_finds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(8)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rng.getrandbits(64) for _ in range(12)]
    prints = [rng.getrandbits(64) for _ in range(60)]
    for item in items:
        for far in (0, 1, 15, 22, 23, 23, 24, 30):
            prints.append(item ^ sum(1 << b for b in rng.sample(range(64), far)))
    prints.append(items[0] ^ 0x0707070707070703)  # three bits in seven blocks, two in the last: 23
    for radius in (7, 23):
        want = {(p, i) for p, a in enumerate(prints) for i, b in enumerate(items) if (a ^ b).bit_count() <= radius}
        left = spark.createDataFrame([(p, signed(x)) for p, x in enumerate(prints)], "p long, fp long")
        right = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(items)], "i long, fp long")
        index = decontaminate._blocks(right, radius // decontaminate.BLOCKS).withColumnRenamed("fp", "ip")
        met = decontaminate._blocks(left).join(index, ["way", "value"])
        assert {(r["p"], r["i"]) for r in met.where(f"bit_count(fp ^ ip) <= {radius}").select("p", "i").collect()} == want


def test_leak_search_has_no_python(spark):
    sf = "/root/testdata/sf0.001"
    plan = queries.op2_decontamination(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- back-off scores -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("seed", "chunk"), [(1, 100), (2, 100_000), (3, 17)])
def test_katz_scores(spark, seed, chunk):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary) if rng.random() < 0.6 else vocabulary[int(rng.expovariate(0.4)) % 30] for _ in range(rng.randint(0, 40))) for _ in range(50)]
    texts[3:6] = [None, "", "Zzz qqq " + texts[6]]
    rows = [(i, t, i % 5 != 1, 0.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean, score double")
    got = {r["doc_id"]: r for r in lm_scoring.fit_and_score(df, "train", chunk_tokens=chunk, bucket_keys=20).collect()}

    tokens = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]
    one, two, history = Counter(), Counter(), Counter()
    for _, text, train, _ in rows:
        before = "<s>"
        for w in tokens(text) if train else ():
            one[w] += 1
            two[before, w] += 1
            history[before] += 1
            before = w
    total = one.total()
    levels = lambda c: [sum(1 for v in c.values() if v == r) for r in range(1, 7)]
    keep1, keep2 = lm_scoring.discounts(levels(one)), lm_scoring.discounts(levels(two))
    share = lambda keep, r: (keep[r] if r <= 5 else 1.0) * r
    unseen = 1 - sum(share(keep1, r) for r in one.values()) / (total + 1)
    p1 = lambda w: share(keep1, one[w]) / (total + 1) if one[w] else unseen
    followers = defaultdict(list)
    for h, w in two:
        followers[h].append(w)
    alpha = {h: (1 - sum(share(keep2, two[h, w]) for w in ws) / (history[h] + 1)) / (1 - sum(map(p1, ws))) for h, ws in followers.items()}
    p = lambda w, h: share(keep2, two[h, w]) / (history[h] + 1) if two[h, w] else alpha.get(h, 1.0) * p1(w)
    for h in followers:
        assert sum(p(w, h) for w in [*one, "never seen"]) == pytest.approx(1, abs=1e-12)
    for i, text, _, _ in rows:
        before, score, base = "<s>", 0.0, 0.0
        for w in tokens(text):
            score += math.log10(p(w, before))
            base += math.log10((one[w] + 0.5) / (total + 0.5 * (len(one) + 1)))
            before = w
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(text)), sum(one[w] > 0 for w in tokens(text)), total)
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["base_score"] == pytest.approx(base, abs=1e-9)


def test_katz_beats_the_base_on_held_out_text(spark):
    got = queries.op1_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_katz_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (None, None, False)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm_scoring.fit_and_score(df, "train").collect()}
    assert got[1]["score"] == 0.0 and got[1]["n_known"] == 0 and got[None]["n_tokens"] == 1
    assert lm_scoring.fit_and_score(df.where("false"), "train").count() == 0


# --- pages -----------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home page</a></li></ul></nav>
<!-- x --><div class="ad">Buy this thing now</div>%s<form><label>Name</label></form><footer>&copy; site</footer><script>var x = "<p>no</p>";</script></body></html>"""
BODY = "<h1>A title</h1><p>First &lt;para&gt; with   <b>bold</b>text\n and many more words.<p>Second&amp;last<br>line of many words here.<aside>Also read</aside><section class='reader-comments'><p>Nice one</p></section>"
TEXT = "A title\n\nFirst <para> with boldtext and many more words.\n\nSecond&last line of many words here."


def test_page_text(spark):
    pages = [PAGE % f"<article>{BODY}</article>", PAGE % f"<div>{BODY}</div>", None, "", "no markup at all", "<p>open <", PAGE % ""]
    df = spark.createDataFrame([(i, h, "old") for i, h in enumerate(pages)], "page_id long, html string, text string")
    weights = html_extract.learn_weights(df)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, weights).collect()}
    assert got == {0: TEXT, 1: TEXT, 2: "", 3: "", 4: "no markup at all", 5: "open <", 6: ""}
    none = df.where("false")
    assert html_extract.learn_weights(none) == {} and html_extract.extract(none, {}).count() == 0


def test_page_text_of_the_tables(spark):
    import html as markup
    import re

    pages = {r["page_id"]: r["html"] for r in queries.read(spark, "/root/testdata/sf0.001", "pages").collect()}
    for r in queries.op6_html_extraction(spark, "/root/testdata/sf0.001").collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(markup.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_text_after_a_foreign_element_that_closes_itself():
    pages = ["<p>one <svg width='1'/>two</p>", "<p>one <math/>two</p>", "<p>one <svg><path/>no</svg>two</p>", "<p>one <script src='x'/>no</script>two</p>"]
    for page in pages:
        text = "".join(t for t in html_extract.Page(page).text if t)
        assert "two" in text and "no" not in text.split()


def test_best_run():
    rng = random.Random(1)
    import numpy as np

    for _ in range(200):
        scores = np.array([rng.randint(-3, 3) for _ in range(rng.randrange(1, 12))], float)
        a, b = html_extract.best_run(scores)
        assert scores[a:b].sum() == max([0.0] + [scores[i:j].sum() for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])


# --- quality ---------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.read(spark, sf, "documents"), queries.read(spark, sf, "labels")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality.score(docs, labels.where(~held)).join(labels.where(held).withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id").toPandas()
    assert len(got) > 500
    right = lambda name, label: ((got[name] >= 0.5) == (got[label] == 1)).mean()
    assert right("quality", "q") > 0.93 and right("toxic", "t") > 0.96
    clean = got[(got["q"] == 1) & (got["t"] == 0)]
    assert ((clean["quality"] >= 0.5) & (clean["toxic"] < 0.5)).mean() > 0.95
    assert ((got["toxic"] >= 0.5)[got["t"] == 1]).mean() > 0.75


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "", "s", "en"), (2, "a b", "s", None), (2, "a b", "s", None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["quality"] <= 1 and 0 <= r["toxic"] <= 1 for r in got)
    assert quality.score(docs.where("false"), labels.where("false")).count() == 0


def test_quality_learns_from_all_rows(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word t"), F.col("id") % 7).alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), (F.col("id") % 3 == 0).cast("long").alias("toxic"))
    seen, view = [], quality.View(None, 0.0, 0.0)
    counting = quality.term_counts
    monkeypatch.setattr(quality, "term_counts", lambda rows, targets: seen.append(rows.count()) or counting(rows, targets))
    monkeypatch.setattr(quality, "co_train", lambda own, pool, settings: seen.append((own.count() < 150, pool.count())) or dict.fromkeys(quality.VIEWS, view))
    assert quality.score(docs, labels, settings=quality.Settings(labelled_rows=60)).count() == 30_000
    assert seen == [300, (True, 29_700), (True, 29_700)]


# --- pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "tu", "ri") for b in ("ran", "sel", "dor", "pit", "mun", "vey", "zo")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(150) for _ in range(12)]
    leak, passage = text(40), text(90)
    texts = dict(enumerate(clean))
    texts |= {20: clean[0], 21: clean[0] + ".", 30: text(60) + " " + leak + " " + text(60), 40: text(60) + " " + passage + " " + text(60), 41: text(50) + " " + passage, 50: "12345 !!!", 51: None, 52: ""}
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in texts.items()], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = queries.read(spark, str(tmp_path), "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert set(kept["language_id"]) == set(texts) - {50, 51, 52}
    assert set(kept["simhash_near_dedup"]) == set(texts) - {20, 21, 50, 51, 52}
    assert passage not in kept["suffix_array_dedup"][40]["text"] and all(kept["suffix_array_dedup"][i]["text"] == t for i, t in enumerate(clean))
    assert all(r["n_chars"] == len(r["text"]) for r in kept["suffix_array_dedup"].values())
    assert set(kept["benchmark_decontamination"]) == set(kept["suffix_array_dedup"]) - {30}
    assert set(kept["best_fit_packing"]) == set(kept["benchmark_decontamination"])


def test_pipeline_runs_on_the_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_leaking_texts_go_whatever_their_id(spark, tmp_path):
    import corpus_pipeline

    leak = " ".join(f"q{i}" for i in range(30))
    spark.createDataFrame([(0, leak), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a " + leak), (7, leak + " b"), (7, "clean words"), (7, "clean words"), (8, leak + " b"), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in docs.collect() if leak not in (r["text"] or ""))
    assert corpus_pipeline.decontaminated(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_scratch_tables_go_with_their_block(spark):
    import os

    from tablewright.llm import common

    with common.scratch(spark):
        with common.scratch(spark):
            inner = common.materialise(spark.range(3), "inner")
            lasting = common.materialise(inner.selectExpr("id + 1 AS id"), "lasting", keep=True)
        assert lasting.count() == 3
        out = common.materialise(lasting, "out", keep=True)
    there = lambda df, name: [f for f in df.inputFiles() if name in f and os.path.exists(f.removeprefix("file://"))]
    assert out.count() == 3 and there(out, "out") and not there(lasting, "lasting") and not there(inner, "inner")
