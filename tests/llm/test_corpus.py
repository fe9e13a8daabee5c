"""Each operator against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprints, licenses, linededup, mixing, neardup, neighbours, packing, pii, quality, toxicity
from quire.llm import text as kernels

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, gone string, shift double, e int, key string, size int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def frame(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "t", "g", 1.5, 3, "k", 9) for i, t, s in rows], DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = [sentence(rng, 60) for _ in range(12)]
    out = [(0, None, "a"), (1, "", None), (2, " \n\t", "a"), (3, "one two", "b"), (4, "one two", "b"), (5, "ONE  two", "b")]
    for i, t in enumerate(base):
        w = t.split()
        out.append((10 + 3 * i, t, "a"))
        out.append((11 + 3 * i, " ".join(w[:30] + ["changed"] + w[31:]), "a"))
        out.append((12 + 3 * i, t + "\n" + base[(i + 1) % 12], "c"))
    out.append((100, sentence(rng, 30_000), "a"))
    out.append((101, "é" * 5000 + " ünïcode 中文 \U0001f600 don't we'll twice more", None))
    out.append((10, base[0], "a"))
    out.append((None, base[1], "a"))
    return out


def test_words_equal_regular_expressions(rows):
    texts = [t for _, t, _ in rows]
    body, offsets = kernels.buffers(pa.array(texts, pa.string()))
    for kind, pattern in ((kernels.SPACED, r"[^\x20\x09-\x0D]+"), (kernels.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, owner = kernels.words(kernels.LOWER[body], offsets, kind)
        for i, t in enumerate(texts):
            own = [kernels.LOWER[body][a:b].tobytes().decode() for a, b, r in zip(starts, ends, owner) if r == i]
            lowered = (t or "").translate({c: c + 32 for c in range(65, 91)})
            assert own == re.findall(pattern, lowered)


def test_quality_keeps_clean_documents(spark):
    rng = random.Random(1)
    good = [(i, ". ".join(sentence(rng, 9) for _ in range(8)), f"s{i % 5}") for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(rng, 60).split()), "s9") for i in range(60)]
    docs = frame(spark, good + bad + [(2000, None, None), (2001, "", "s1")])
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good[::2] + bad[::2]] + [(None, 1, 0), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(good) + len(bad) + 2
    assert all(got[i]["_keep"] for i, _, _ in good) and not any(got[i]["_keep"] for i, _, _ in bad)
    assert got[3]["shift"] == 1.5
    assert got[1000]["_path_mean"] < 0.2 < 0.8 < got[0]["_path_mean"]
    none = labels.limit(0)
    assert all(r["_keep"] and abs(r["_score"] - 0.5) < 1e-9 for r in quality.classify(docs, none).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sites_shrink_toward_their_parents(spark):
    rows = [("big", "x", 0.9)] * 200 + [("big", "y", 0.1)] * 200 + [("small", "x", 0.0)]
    got = {(r["host"], r["path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert got["big", "x"]["path_mean"] > 0.8 > 0.2 > got["big", "y"]["path_mean"]
    assert 0.2 < got["small", "x"]["path_mean"] < 0.5


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    return out


def brute_near(rows):
    rows = [(i, t) for i, t, _ in rows if i is not None]
    sets = brute_sets([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    similar = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            similar[a] += 1
            similar[b] += 1
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(sets[i]), similar[i], least[find(i)]) for i, (k, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, rows):
    got = neardup.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(tuple(r) for r in got if r[0] is not None) == brute_near(rows)
    assert [tuple(r)[1:] for r in got if r[0] is None] == [(56, 0, None)]
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(9)
    base = sentence(rng, 120).split()
    group = [(i, " ".join(base[: 3 * (i % 30)] + [f"v{i % 45}"] + base[3 * (i % 30) + 1 :]), "a") for i in range(260)]
    group += [(1000 + i, sentence(rng, 20) + " " + " ".join(base[:60]), "b") for i in range(80)]
    got = neardup.near_duplicates(frame(spark, group)).select("doc_id", "n_shingles", "n_similar", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_near(group)
    kept = neardup.distinct_documents(frame(spark, group))
    assert kept.columns == frame(spark, group).columns and kept.count() == len({r[3] for r in brute_near(group)})


def test_components_of_a_long_path(spark):
    from quire.llm.setjoin import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert {k: v for k, v in got.items() if k != v} == {**{i: 0 for i in range(1, 301)}, 501: 500}


def bag(line):
    w = line.translate({c: c + 32 for c in range(65, 91)}).split()
    return {(x, w[:j].count(x)) for j, x in enumerate(w)}


def removed_lines(docs):
    """Of rows (doc_id, text) with distinct ids: the (doc_id, line number) that match an earlier line."""
    bags = [(k, n, bag(s)) for k, t in sorted(docs) for n, s in enumerate((t or "").split("\n"))]
    bags = [b for b in bags if b[2]]
    return {(k, n) for j, (k, n, s) in enumerate(bags) if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in bags[:j])}


def test_repeated_lines_equal_brute_force(spark, rows):
    rng = random.Random(2)
    extra = [(200 + i, "\n".join(rng.choice(["short one", sentence(random.Random(rng.randrange(25)), 20), "", " \t"]) for _ in range(6)), "z") for i in range(40)]
    docs = [r for r in rows if r[0] is not None][:-1] + extra
    gone = removed_lines([(k, t) for k, t, _ in docs if k != 100 and t is not None] + [(100, docs[[r[0] for r in docs].index(100)][1])])
    want = {k: None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if (k, n) not in gone) for k, t, _ in docs}
    cleaned = linededup.dedup_lines(frame(spark, docs)).collect()
    assert {r["doc_id"]: r["text"] for r in cleaned} == want
    assert {r["gone"] for r in cleaned} == {"g"} and len(gone) > 50
    assert all(r["_lines"] == (0 if want[r["doc_id"]] is None else dict((k, t) for k, t, _ in docs)[r["doc_id"]].count("\n") + 1) for r in cleaned)
    assert sum(r["_removed"] for r in cleaned) == len(gone)
    assert linededup.dedup_lines(frame(spark, docs).limit(0)).count() == 0


def test_rows_with_one_doc_id_keep_their_own_lines(spark):
    """Rows that share doc_id lose only their own repeats; of equal rows one keeps its lines."""
    same = "first line of it\n\nsecond line of it"
    docs = [(1, same, "a")] * 5 + [(1, "second line of it\nunique precious line here", "a"), (1, "short\nshort", "a"), (2, same, "a"), (None, same, "a"), (None, same, "a"), (3, None, "a"), (3, None, "a"), (4, "", "a"), (4, "", "a")]
    got = linededup.dedup_lines(frame(spark, docs)).collect()
    texts = sorted((str(r["doc_id"]), r["text"] if r["text"] is not None else "-") for r in got)
    of = lambda k: [t for i, t in texts if i == k]
    assert len(got) == len(docs) and of("None") == [same, same] and of("3") == ["-", "-"] and of("4") == ["", ""] and of("2") == [""]
    assert of("1").count("") == 4 and any("unique precious line here" in t for t in of("1")) and "short" in of("1")
    lines = [x for t in of("1") for x in t.split("\n")]
    assert sorted(x for x in lines if x) == ["first line of it", "second line of it", "short", "unique precious line here"]


def test_hot_prefix_tokens_are_spread(spark):
    """Tokens of more sets than a salt holds give the same links."""
    from quire.llm import setjoin

    rng = random.Random(21)
    rows = [(i, 0, " ".join(["hot", *(f"w{rng.randrange(60)}" for _ in range(8))])) for i in range(400)]
    rows += [(400 + i, 0, t + " more") for i, (_, _, t) in enumerate(rows[::4])]
    items = spark.createDataFrame(rows, "id long, tie long, text string")
    seen = setjoin.durable(setjoin.signed(items, linededup.word_sets))
    often = setjoin.frequencies(seen)
    found = [{tuple(sorted((r["x"], r["y"]))) for r in setjoin.common_pairs(items, linededup.word_sets, 80, 100, often, 8, split=split).collect()} for split in (2, 1 << 30)]
    key = {(r["id"]): r["s1"] for r in seen.where("counts IS NULL").collect()}
    bags = {i: bag(t) for i, _, t in rows}
    true = {tuple(sorted((key[i], key[j]))) for i, j in combinations(bags, 2) if bags[i] != bags[j] and 100 * len(bags[i] & bags[j]) >= 80 * len(bags[i] | bags[j])}
    assert true and true <= found[0] and true <= found[1]


def test_large_groups_of_similar_lines_are_not_paired(spark):
    """Of a group that grows with the table each line meets a bounded number of others, and still none is lost."""
    from quire.llm import setjoin

    rng = random.Random(5)
    base = sentence(rng, 60).split()

    def variant(k):
        w = list(base)
        for at in rng.sample(range(60), k):
            w[at] = f"own{rng.randrange(40)}"
        return " ".join(w)

    texts = [variant(rng.randrange(1, 9)) for _ in range(300)]
    # one a doc; then several of one doc, and unlike lines that share the group's rare words
    docs = [(i, t) for i, t in enumerate(texts[:200])] + [(300 + i, "\n".join(texts[200 + 10 * i : 210 + 10 * i])) for i in range(10)]
    docs += [(500 + i, " ".join(base[: 30 + i % 20] + sentence(rng, 25).split())) for i in range(60)]
    docs = [(997 * i % 1009, t) for i, t in docs]
    items = spark.createDataFrame([(i, 0, t) for i, t in docs], "id long, tie long, text string")
    seen = setjoin.durable(setjoin.signed(items, linededup.word_sets))
    often = setjoin.frequencies(seen)
    pairs = [setjoin.counted(setjoin.meetings(items, linededup.word_sets, 80, 100, often, 4, most=most).where("left IS NULL")).count() for most in (None, 8)]
    assert pairs[0] > 15_000 and 4 * pairs[1] < pairs[0], pairs
    gone = removed_lines(docs)
    want = {k: "\n".join(s for n, s in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in docs}
    table = frame(spark, [(i, t, "a") for i, t in docs])
    assert len(gone) > 200
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table).collect()} == want
    # with one other at a token many sets are left to be compared with the rest
    lines, classes = seen.where("counts IS NULL"), setjoin.classes_of(seen.where("counts IS NULL"))
    found = {tuple(r) for r in setjoin.matched(items, seen, classes, linededup.word_sets, 80, 100, most=1).collect()}
    by = {}
    for r in lines.collect():
        by[r["s1"]] = min(by.get(r["s1"], (1 << 40, 0, 0)), (r["id"], r["tie"], r["number"]))
    bags = {e: bag(dict(docs)[i].split("\n")[n]) for e, (i, _, n) in by.items()}
    true = {(e,) for e in bags if any(by[o] < by[e] and 100 * len(bags[e] & bags[o]) >= 80 * len(bags[e] | bags[o]) for o in bags)}
    assert found == true


def test_distinct_per_row_with_tied_upper_bits():
    rng = np.random.default_rng(5)
    upper = rng.integers(0, 3, 4000).astype(np.uint64) << np.uint64(40)
    hashes = upper | rng.integers(0, 4, 4000).astype(np.uint64)
    rows = rng.integers(0, 3, 4000)
    h, r = kernels.distinct_per_row(hashes, rows)
    assert sorted(zip(r.tolist(), h.tolist())) == sorted(set(zip(rows.tolist(), hashes.tolist()))) == list(zip(r.tolist(), h.tolist()))


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, (1200, 1))
    v[7] = v[6]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0, 2.0]), (None, v[0].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = neighbours.search(table, block=300, sample=200).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 1200, 20))
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and q not in {r["vec_id"] for r in found}
        assert all(abs(r["score"] - v[q] @ v[r["vec_id"]]) < 1e-9 for r in found)
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(1200), -scores))[:20].tolist()))
    assert hits >= 0.9 * 20 * len(by)
    few = neighbours.search(spark.createDataFrame(rows[:3], table.schema)).collect()
    assert len(few) == 2
    assert neighbours.search(table.limit(0)).count() == 0


def test_licenses(spark, rows):
    mit = licenses.TEMPLATES[0][1]
    changed = mit.replace("free of charge", "without any charge")
    more = [(300, "x y MIT License, mit license! z", "a"), (301, "pre " * 50 + changed + " post" * 50, "a"), (302, "Licensed under CC BY-NC 4.0.", "a"), (303, "The General Public License and the Apache License", "a")]
    docs = [*rows, *more]
    got = licenses.scan_licenses(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for k, t, _ in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [(i, lab) for phrase, lab in licenses.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = by[k]
        if k not in (10, None):
            assert (r["n_words"], r["n_base"]) == (len(w), len(at))
            assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
    assert by[301]["labels"] == "mit" and by[301]["n_base"] == 0 and by[302]["labels"] == "cc-by-nc" and by[3]["labels"] == ""
    assert by[303]["labels"] == "apache,gpl"
    assert licenses.scan_licenses(frame(spark, docs).limit(0)).count() == 0


def test_packing_round_trip(spark, rows):
    path = packing.default_vocabulary()
    enc = packing.Encoder(path)
    rng = random.Random(8)
    odd = ["".join(rng.choice("ab'stred  \n\t.,19Zé’中 ​\U0001f600") for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, bounds = enc.encode(*kernels.buffers(pa.array(odd)))
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(path)
    want = [e.ids for e in fresh.encode_batch(odd, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    docs = [r for r in rows if r[0] is not None][:-1] + [(1000 + i, t, "q") for i, t in enumerate(odd[:500])]
    got = packing.pack(frame(spark, docs), path, with_ids=True).collect()
    pieces, windows = {}, {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    for k, t, _ in docs:
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == [*fresh.encode(t or "", add_special_tokens=False).ids, 1]
        assert all(r["doc_tokens"] == sum(x["length"] for x in own) for r in own)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert w[0]["offset"] == 0 and all(a["offset"] + a["length"] == b["offset"] for a, b in zip(w, w[1:]))
        assert w[-1]["offset"] + w[-1]["length"] <= 2048
    assert packing.pack(frame(spark, docs).limit(0), path).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 700, 300).tolist()
    windows = packing.differencing(sizes, 24)
    assert sorted(i for w in windows for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= 8


def test_mixing_fills_targets(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        key = (r["source_size"], r["target"])
        taken[key] = taken.get(key, 0) + r["taken"]
    assert all(t == int(target) for (_, target), t in taken.items())
    total = sum(size for size, _ in taken)
    assert abs(sum(target for _, target in taken) - 1.5 * total) < 1e-6
    assert sorted(map(tuple, mixing.mix(frame(spark, rows)).where("doc_id IS NOT NULL").collect())) == sorted(tuple(r) for r in got if r["doc_id"] is not None)
    copies = mixing.mixed(frame(spark, rows))
    assert copies.columns == frame(spark, rows).columns and copies.count() > len(rows) // 2
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_base_spans_equal_regular_expressions():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("01259 .-+()@ab.é") for _ in range(rng.randrange(50)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"\D", "", m.group())
            if 16 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
        assert pii.base_spans(t) == want


def test_pii_field(spark, rows):
    docs = [*rows, (300, "mail ana.b@mail.example.com or call (555) 123-4567 now, page 12", "a"), (301, "call 555-867-5309 today. Later 555-867-5309 again", "a")]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, docs)).collect()}
    assert got[300]["n_email"] == 1 and got[300]["spans"].startswith("email:5:27") and "phone:36:50" in got[300]["spans"]
    assert got[300]["base_sha256"] == hashlib.sha256(b"email:5:27").hexdigest()
    assert got[301]["spans"].count("phone") == 2
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(frame(spark, docs).limit(0)).count() == 0


def test_skip_edges_pull_repeated_words_together():
    model = pii.train()
    plain = np.zeros((3, len(pii.LABELS)))
    plain[0, 4], plain[2, 0] = 4.0, 0.5
    apart = pii.marginals(plain, np.zeros((0, 2), int), np.zeros((0, 2), int), model[1], model[2])
    tied = pii.marginals(plain, np.zeros((0, 2), int), np.array([[0, 2]]), model[1], model[2])
    assert tied[2, 4] > 2 * apart[2, 4]


def test_toxicity_gradients_and_learning(spark):
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model().items()}
    batch = toxicity.Batch(*kernels.buffers(pa.array(["you idiot go home", "a b c", "", "x y"], pa.large_string())))
    push = np.array([1.0, -2.0, 0.5, 3.0])
    _, cache = toxicity.forward(m, batch, np.arange(4), True)
    grads = toxicity.backward(m, batch, cache, push)
    for k in ("fU", "bW", "attend", "out", "word", "char"):
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        ends = [(toxicity.forward({**m, k: m[k] + s * 1e-3 * (np.indices(m[k].shape) == np.array(i).reshape(-1, *[1] * m[k].ndim)).all(0)}, batch) * push).sum() for s in (1, -1)]
        assert abs((ends[0] - ends[1]) / 2e-3 - grads[k][i]) < 1e-3 * max(1, abs(grads[k][i]))
    rng = random.Random(6)
    texts = [(i, sentence(rng, 70) + (" you worthless moron " if i % 3 == 0 else " ") + sentence(rng, 40), "a") for i in range(300)]
    docs = frame(spark, [*texts, (400, None, "a"), (401, "", "b")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for k, r in got.items())
    held = [k for k in range(300) if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == int(k % 3 == 0) for k in held]) > 0.9
    assert {r["predicted"] for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0}


def test_fingerprints(spark, rows):
    docs = sorted(((i, t or "") for i, t, _ in rows if i is not None), key=lambda r: (r[0], r[1].encode()))[:-3]
    got = fingerprints.fingerprint(frame(spark, [(i, t, "a") for i, t in docs])).collect()
    assert len(got) == len(docs)
    got.sort(key=lambda r: (r["doc_id"], r["n_chars"]))

    def digest(t):
        b = t.encode()
        r, _, h = fingerprints.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        return fingerprints.filters(r, h, 1)[0]

    for i, (k, t) in enumerate(docs):
        follow = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + follow[:q]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert r["fingerprint"] == fingerprints.encoded(digest(t)) and r["edited_fingerprint"] == fingerprints.encoded(digest(edited))
        if len(t) > 300 and follow:
            assert r["near_edited"] > 0.4
    assert fingerprints.fingerprint(frame(spark, rows).limit(0)).count() == 0
    one = fingerprints.fingerprint(frame(spark, [(1, "abcdefgh", "a")])).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    b = np.random.default_rng(0).integers(97, 110, 400).astype(np.uint8)
    sums = fingerprints.window_sums(b)
    assert all(sums[i] == fingerprints._CLOG[np.bincount(b[i : i + 64], minlength=256)].sum() for i in range(len(sums)))


def test_pipeline_stages(spark, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
    assert docs.count() > 0
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_lines_repeated_by_words_equal_brute_force(spark):
    rng = random.Random(12)
    docs = []
    for i in range(60):
        lines = ["All rights reserved.", "menu", "", " ", rng.choice(["x x y z", "x y z x", "x y z z"])]
        for _ in range(4):
            w = sentence(random.Random(rng.randrange(30)), rng.choice([9, 12, 20, 40])).split()
            at = rng.randrange(len(w))
            lines.append(" ".join(w[:at] + rng.choice([[w[at]], ["new"], [w[at], "new"], []]) + w[at + 1 :]))
        docs.append((i, "\n".join(lines), "a"))
    gone = removed_lines([(k, t) for k, t, _ in docs])
    want = {k: "\n".join(s for n, s in enumerate(t.split("\n")) if (k, n) not in gone) for k, t, _ in docs}
    cleaned = linededup.dedup_lines(frame(spark, docs))
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == want
    assert {(i, 0) for i in range(1, 60)} <= gone and "\nmenu\n" in want[0] and "menu" not in want[1]
    assert linededup.dedup_lines(frame(spark, docs).limit(0)).count() == 0


def test_pipeline_drops_lines_with_one_changed_word(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = sentence(random.Random(1), 12).split()
    changed = " ".join(words[:6] + ["other"] + words[7:])
    docs = frame(spark, [(1, " ".join(words), "a"), (2, changed + "\nown line", "a")])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert out == {1: " ".join(words), 2: "own line"}


def test_pipeline_drops_repeats_of_short_lines(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, [(1, "first own line\n\nAll rights reserved.\nmenu", "a"), (2, "all  rights reserved.\nsecond own text here\n\nmenu", "a")])
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert out == {1: "first own line\n\nAll rights reserved.\nmenu", 2: "second own text here\n"}


def test_fingerprints_of_texts_without_a_voted_window(spark):
    rng = random.Random(5)
    prose = " ".join(rng.choice(WORDS) for _ in range(9000))
    texts = [prose[i * 211 : i * 211 + n] for i, n in enumerate(range(127, 201))]
    texts += ["spam " * 300, "ab" * 2000, "x" * 700, prose[:9000] + "z" * 3000, "z" * 12_000, "-=+ " * 40, prose[500:2500], ""]
    got = sorted(fingerprints.fingerprint(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect(), key=lambda r: r["doc_id"])

    def digest(t):
        b = t.encode()
        r, _, h = fingerprints.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        return fingerprints.encoded(fingerprints.filters(r, h, 1)[0])

    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        assert got[i]["fingerprint"] == digest(t) and got[i]["edited_fingerprint"] == digest(edited)
        assert (got[i]["fingerprint"] == "") == (t == "") and (got[i]["edited_fingerprint"] == "") == (edited == "")
    assert len({r["fingerprint"] for r in got[:78]}) == 77 + 1 and all(r["near_next"] < 0.5 for r in got[70:77])


def recall_of(spark, v, k=20):
    """Share of the true neighbours found, and the rows found; every query has k."""
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    by = {}
    for r in neighbours.search(table).collect():
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, len(v), 20))
    hits = 0
    for q, found in by.items():
        assert len(found) == min(k, len(v) - 1)
        scores = v @ v[q]
        scores[q] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(len(v)), -scores))[:k].tolist()))
    return hits / (min(k, len(v) - 1) * len(by))


@pytest.mark.parametrize("norms", ["equal", "one long", "spread"])
def test_neighbours_recall_whatever_the_norms(spark, norms):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if norms == "one long":
        v[5] *= 10
    if norms == "spread":
        v *= rng.lognormal(0, 0.5, (len(v), 1))
    assert recall_of(spark, v) >= 0.9


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_neighbours_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    assert recall_of(spark, np.array([r["embedding"] for r in rows], float)) >= 0.9


def test_neighbours_verify_a_part_of_the_pairs():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(16_384, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, asked = np.arange(len(v)), np.arange(0, 800, 20)
    reach = np.sort(v[asked] @ v[:2_048].T, axis=1)[:, -21]
    index, seen = neighbours.Block(v, ids, 512), []
    scores = index._scores
    index._scores = lambda queries, q, x: (seen.append(len(q)), scores(queries, q, x))[1]
    q, found, score = index.search(v[asked], asked, reach, 20)
    assert sum(seen) < 0.15 * len(asked) * len(v)
    full = v[asked] @ v.T
    full[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-full, axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(found[q == a]) & set(w)) / 20 for a, w in zip(asked, want)]) >= 0.9


@pytest.mark.parametrize("norms", ["equal", "spread", "huge"])
def test_neighbours_of_short_vectors_are_exact(spark, norms):
    """None is missed, and few pairs are looked at in double precision."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(5_000, 32))
    v *= {"equal": 1 / np.linalg.norm(v, axis=1, keepdims=True), "spread": rng.lognormal(0, 0.7, (5_000, 1)), "huge": np.full((5_000, 1), 1e150)}[norms]
    v[40:60] = v[40] * np.float64(1) + rng.normal(size=(20, 32)) * 1e-12 * np.abs(v[40]).max()  # nearer than single precision tells
    assert recall_of(spark, v) == 1
    asked = np.arange(0, 5_000, 20)
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -np.inf
    index, seen = neighbours.Screened(v, np.arange(5_000)), []
    exact = index._scores
    index._scores = lambda queries, q, x: (seen.append(len(q)), exact(queries, q, x))[1]
    q, found, _ = index.search(v[asked], asked, np.sort(scores[:, :2_048], axis=1)[:, -20], 20)
    assert sum(seen) < 0.05 * scores.size
    # ties within double rounding aside, the rows of brute force
    kth = np.sort(scores, axis=1)[:, -20]
    assert all(scores[i, found[q == a]].min() >= kth[i] - 1e-9 * abs(kth[i]) and (q == a).sum() == 20 for i, a in enumerate(asked))


def test_neighbours_of_long_vectors_use_the_index(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(400, 64))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    results = [{(r["query_id"], r["rank"]): r["vec_id"] for r in neighbours.search(table, m=m).collect()} for m in (8, 512)]
    assert results[0].keys() == results[1].keys() and np.mean([results[0][k] == results[1][k] for k in results[1]]) > 0.5


def test_neighbours_tie_and_overflow(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1_100, 16))
    v[100:1_050] = v[100]  # equal vectors have equal scores, the smaller id first
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5_000, [1e200] * 16), (5_001, [1e-200] * 16), (5_002, [1e306, -1e306] * 8)]
    by = {}
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        by.setdefault(r["query_id"], []).append(r)
    assert {len(x) for x in by.values()} == {20} and set(by) == {*range(0, 1_100, 20), 5_000}
    same = [r["vec_id"] for r in by[100] if abs(r["score"] - v[100] @ v[100]) < 1e-9]
    assert same == sorted(same) and len({r["score"] for r in by[100] if r["vec_id"] in range(100, 1_050)}) == 1
    for q in range(0, 100, 20):
        large = [r["vec_id"] for r in by[q] if r["vec_id"] >= 5_000]
        assert large == [r["vec_id"] for r in by[q]][: len(large)] and set(large) == {i for i, x in ((5_000, v[q].sum()), (5_002, v[q][::2].sum() - v[q][1::2].sum())) if x > 0}


def test_counters_add_bitmaps():
    rng = np.random.default_rng(1)
    bits = rng.random((37, 3, 128)) < 0.6
    count = neighbours.Counters((3, 2), 37)
    for b in bits:
        count.add(np.packbits(b, axis=1, bitorder="little").view(np.uint64))
    for least in (0, 1, 20, 22, 37):
        count2 = neighbours.Counters((3, 2), 37)
        for b in bits:
            count2.add(np.packbits(b, axis=1, bitorder="little").view(np.uint64))
        got = np.unpackbits(count2.reached(least).view(np.uint8), axis=1, bitorder="little").astype(bool)
        assert (got == (bits.sum(0) >= least)).all()


def test_distinct_documents_keep_one_of_repeated_rows(spark):
    rng = random.Random(3)
    a, b = sentence(rng, 30), sentence(rng, 30)
    docs = frame(spark, [(1, a, "a")] * 40 + [(1, b, "a"), (2, a.upper(), "a"), (3, None, "a"), (3, "", "a"), (4, sentence(rng, 30), "a"), (None, a, "a"), (None, a, "a")])
    got = neardup.distinct_documents(docs)
    assert got.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(kept, key=repr)[:2] == sorted([(1, a), (1, b)], key=repr)
    assert sorted(str(k) for k, _ in kept) == ["1", "1", "3", "4", "None", "None"]


def test_packing_takes_added_tokens_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    plain = Tokenizer.from_file(path)
    added = next(t.content for t in plain.get_added_tokens_decoder().values())
    texts = ["one two", f"one{added}two {added}", "", added, added[:-1], "é three", f"{added[:4]}", f"{added[4:]} x"]
    ids, bounds = packing.Encoder(path).encode(*kernels.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(ids[bounds[3] : bounds[4]]) == 1


def test_license_labels_equal_a_nested_loop(spark):
    """Labels and scores by counting, for each document and template, the shared grams of each band of diagonals."""
    rng = random.Random(14)
    docs = []
    for i in range(60):
        label, text = rng.choice(licenses.TEMPLATES)
        w = text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(3)
        docs.append((i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) + " " + " ".join(w) + " tail", "a"))
    docs += [(100, "Licensed under the CC BY-NC 4.0", "a"), (101, "", "a"), (102, None, "a")]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    k, band = 3, 8
    for r in licenses.scan_licenses(frame(spark, docs)).collect():
        w = split(dict((i, t) for i, t, _ in docs)[r["doc_id"]])
        labels, best = set(filter(None, r["base_labels"].split(","))), 0.0
        for label, text in licenses.TEMPLATES:
            t = split(text)
            hits = [(i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k]]
            for b in {(i - j) // band for i, j in hits} | {(i - j) // band - 1 for i, j in hits}:
                own = {x for i, j in hits if (i - j) // band in (b, b + 1) for x in range(j, j + k)}
                share = len(own) / len(t)
                if share >= 0.7:
                    labels.add(label)
                    best = max(best, min(share, 1.0))
        assert r["labels"] == ",".join(sorted(labels)), r["doc_id"]
        assert abs(r["score"] - (1.0 if r["n_base"] else best)) < 1e-12
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(frame(spark, docs[-3:])).collect()}[100] == "cc-by-nc"


def test_site_posteriors_equal_plain_python(spark):
    rng = random.Random(5)
    rows = [(f"h{h}", f"p{p}", rng.random() ** (1 + h % 3)) for h in range(6) for p in range(3) for _ in range(rng.randrange(1, 30))] + [(None, "p0", 0.4), ("h0", None, 0.9)]
    n, mean = len(rows), sum(r[2] for r in rows) / len(rows)
    group = lambda key: {k: [r[2] for r in rows if key(r) == k] for k in {key(r) for r in rows}}

    def pseudo(sites, parent):
        between = sum(len(v) * (sum(v) / len(v) - parent(k)) ** 2 for k, v in sites.items())
        noise = sum(parent(k) * (1 - parent(k)) for k in sites)
        spread = max((between - noise) / n, 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4)

    hosts, paths = group(lambda r: r[0]), group(lambda r: r[:2])
    kh = pseudo(hosts, lambda k: mean)
    host = {k: (sum(v) + kh * mean) / (len(v) + kh) for k, v in hosts.items()}
    kp = pseudo(paths, lambda k: host[k[0]])
    want = {k: (sum(v) + kp * host[k[0]]) / (len(v) + kp) for k, v in paths.items()}
    got = {(r["host"], r["path"]): r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert set(got) == set(want) and all(abs(got[k]["path_mean"] - want[k]) < 1e-9 for k in want)
    logit = lambda p: np.log(p / (1 - p))
    assert all(abs(got[k]["shift"] - (logit(want[k]) - logit(mean))) < 1e-9 for k in want)


def test_quality_scores_equal_plain_python(spark):
    rng = random.Random(8)
    docs = [(i, sentence(rng, 20) + ("!!! $$$" * 5 if i % 4 == 0 else "."), f"s{i % 3}") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(60)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    x = quality.features(*kernels.buffers(pa.array([t for _, t, _ in docs])))
    y = np.array([float(i % 4 != 0) for i in range(60)])
    order = np.lexsort((*x[:60].T, y))
    model = quality.fit(x[:60][order], y[order])
    evidence = np.clip(x @ model[:-1] + model[-1], -12, 12)
    sites = {(r["host"], r["path"]): r["shift"] for r in quality.site_posteriors(spark.createDataFrame([(s, "en", float(1 / (1 + np.exp(-e)))) for (_, _, s), e in zip(docs, evidence)], "host string, path string, p double")).collect()}
    for r in quality.classify(frame(spark, docs), labels).collect():
        want = 1 / (1 + np.exp(-(evidence[r["doc_id"]] + 0.5 * sites[docs[r["doc_id"]][2], "en"])))
        assert abs(r["_score"] - want) < 1e-6 and r["_keep"] == (want >= 0.5)


def test_marginals_equal_enumeration():
    """Exact where the graph is a tree, close where it has a loop."""
    from itertools import product

    rng = np.random.default_rng(3)
    n, k = 5, len(pii.LABELS)
    unary, pair, tie = rng.normal(size=(n, k)), rng.normal(size=(k, k)) * 0.5, rng.normal(size=(k, k)) * 0.5

    def exact(chain, skip):
        total = np.zeros((n, k))
        for y in product(range(k), repeat=n):
            e = sum(unary[i, c] for i, c in enumerate(y)) + sum(pair[y[a], y[b]] for a, b in chain) + sum(tie[y[a], y[b]] for a, b in skip)
            for i, c in enumerate(y):
                total[i, c] += np.exp(e)
        return total / total.sum(1, keepdims=True)

    tree = ([(0, 1), (1, 2)], [(2, 4), (0, 3)])
    loop = ([(0, 1), (1, 2), (2, 3)], [(0, 3)])
    for (chain, skip), near in ((tree, 1e-3), (loop, 0.1)):
        got = pii.marginals(unary, np.array(chain), np.array(skip), pair, tie, rounds=200)
        assert np.abs(got - exact(chain, skip)).max() < near


def test_field_finds_held_out_spans():
    """Recall and precision of all spans on sentences that the field was not fitted on."""
    model = pii.train()
    hit = total = found = 0
    for text, spans in pii._generated(300, seed=99):
        base = pii.base_spans(text)
        got = [*base, *pii.field_spans(text, base, model)]
        found += len(got)
        total += len(spans)
        hit += sum(any(k == kind and s < e2 and s2 < e for kind, s2, e2 in got) for k, s, e in spans)
    assert hit >= 0.9 * total and found <= 1.2 * total


def test_recurrent_scores_equal_loops():
    """Each window's logit by scalar loops over words and units."""
    m = {k: v.astype(np.float64) for k, v in toxicity.new_model(3).items()}
    text = "you idiot go home now or else we call them all"
    batch = toxicity.Batch(*kernels.buffers(pa.array([text, ""], pa.large_string())))
    got = toxicity.forward(m, batch)
    h, x = toxicity.HIDDEN, batch.inputs(m).astype(float)
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(d, order, tokens):
        state, out = [0.0] * h, {}
        for t in order:
            p = [sum(x[tokens[t]][i] * m[d + "W"][i, j] for i in range(x.shape[1])) + m[d + "c"][j] for j in range(3 * h)]
            g = [sum(state[i] * m[d + "U"][i, j] for i in range(h)) for j in range(3 * h)]
            z, r = [sig(p[j] + g[j]) for j in range(h)], [sig(p[h + j] + g[h + j]) for j in range(h)]
            new = [np.tanh(p[2 * h + j] + r[j] * g[2 * h + j]) for j in range(h)]
            state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
            out[t] = state
        return out

    n = len(text.split())
    tokens = batch.tokens[0]
    f, b = states("f", range(n), tokens), states("b", range(n - 1, -1, -1), tokens)
    both = [f[t] + b[t] for t in range(n)]
    energy = np.array([sum(s[i] * m["attend"][i] for i in range(2 * h)) for s in both])
    weight = np.exp(energy - energy.max()) / np.exp(energy - energy.max()).sum()
    pooled = sum(w * np.array(s) for w, s in zip(weight, both))
    assert abs(got[0] - (pooled @ m["out"] + m["bias"][0])) < 1e-4 and abs(got[1] - m["bias"][0]) < 1e-6


def test_toxicity_of_one_label_and_odd_tables(spark, rows):
    docs = frame(spark, rows)
    ones = spark.createDataFrame([(i, 1, 1) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, ones).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, ones.limit(0)).collect()} == {0.0}
    both = ones.union(spark.createDataFrame([(i, 1, int(i % 2)) for i in range(10, 40)] * 2, ones.schema))
    once, again = ([tuple(r) for r in toxicity.score(docs, both).orderBy("doc_id", "score").collect()] for _ in range(2))
    assert once == again and len(once) == len(rows)
    assert toxicity.score(docs.limit(0), ones).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage's rows against plain Python on what the stage before it kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    good = [sentence(rng, 40) + "." for _ in range(30)]
    docs = [(i, t + "\nall rights reserved", f"s{i % 3}") for i, t in enumerate(good)]
    docs += [(100 + i, " ".join(w.upper() + "!!" for w in sentence(rng, 40).split()), "s9") for i in range(12)]
    docs += [(200 + i, good[i].replace(good[i].split()[3], "changed", 1) + " " + sentence(rng, 3) + "\nown " + sentence(rng, 8), "s1") for i in range(5)]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(0, 30, 2), *range(100, 112, 2)]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    now = frame(spark, docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{i}")
        now = spark.read.parquet(f"{tmp_path}/stage{i}")
        seen.append([r.asDict() for r in now.collect()])
    scored = {r["doc_id"] for r in quality.classify(frame(spark, docs), labels).where("_keep").collect()}
    assert sorted(r["doc_id"] for r in seen[0]) == sorted(scored) and {d[0] for d in docs[:30]} <= scored and not any(100 <= k < 112 for k in scored)
    kept = [(r["doc_id"], r["text"]) for r in seen[0]]
    gone = removed_lines(kept)
    want = {k: "\n".join(s for n, s in enumerate(t.split("\n")) if (k, n) not in gone) for k, t in kept}
    want = {k: t for k, t in want.items() if t.strip()}
    assert {r["doc_id"]: r["text"] for r in seen[1]} == want and all(r["n_chars"] == len(r["text"]) for r in seen[1])
    roots = {k: root for k, _, _, root in brute_near([(k, t, "") for k, t in want.items()])}
    assert sorted(r["doc_id"] for r in seen[2]) == sorted({*roots.values()})
    size = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in seen[2]}
    total = {s: sum(n for o, n in size.values() if o == s) for s, _ in size.values()}
    taken = {}
    for r in seen[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    # sources by code point weigh 5, 2, 1; no target is above twice its source's size
    left, need = dict(zip(sorted(total), (5, 2, 1))), 1.5 * sum(total.values())
    target = {}
    while left:
        over = [s for s in left if need * left[s] / sum(left.values()) > 2 * total[s]]
        for s in over or list(left):
            target[s] = 2.0 * total[s] if over else need * left[s] / sum(left.values())
        if not over:
            break
        need -= sum(target[s] for s in over)
        left = {s: w for s, w in left.items() if s not in over}
    longest = max(n for _, n in size.values())
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s in total)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_vocabulary())
    count = {}
    for r in seen[3]:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + len(plain.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = {}
    for r in seen[4]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == count


def test_fingerprints_of_crowds(spark):
    """Rows with one doc_id, or with one text as well, are spread over ranges; every row still meets its next one."""
    rng = random.Random(9)
    same = sentence(rng, 40)
    docs = [(7, same)] * 200 + [(7, sentence(rng, 30)) for _ in range(40)] + [(None, sentence(rng, 30)) for _ in range(30)] + [(None, None)] * 50 + [(i, sentence(rng, 20)) for i in range(20, 30)]
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in set(docs)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((-(2**63) if i is None else i, hashes[t or ""], t or "") for i, t in docs))
    want = []
    for j, (i, _, t) in enumerate(order):
        q = len(t) // 4
        follow = order[(j + 1) % len(order)][2]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + follow[:q]).encode()).hexdigest()))
    for ranges in (1, 3, 16, 64):
        got = fingerprints.fingerprint(frame(spark, [(i, t, "a") for i, t in docs]), ranges_=ranges).collect()
        assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want), ranges


def test_word_hashes_tell_words_apart():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab\u00e9") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 300]))) for _ in range(3000)]
    body, offsets = kernels.buffers(pa.array([" ".join(texts)]))
    starts, ends, _ = kernels.words(body, offsets, kernels.SPACED)
    seen = {}
    for t, h in zip(texts, kernels.word_hashes(body, starts, ends).tolist()):
        assert seen.setdefault(t, h) == h
    assert len(set(seen.values())) == len(seen)
    alone = kernels.buffers(pa.array([texts[-1]]))[0]
    assert kernels.word_hashes(alone, np.array([0]), np.array([len(alone)]))[0] == seen[texts[-1]]
    assert len(kernels.word_hashes(body, starts[:0], ends[:0])) == 0


def test_same_rows_without_broadcasts(spark, rows, monkeypatch):
    """Beyond the bound on broadcasts the same joins shuffle, with the same results."""
    from quire.llm import common

    docs = frame(spark, rows)
    labels = spark.createDataFrame([(10 + 3 * i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")

    def results():
        near = sorted(map(repr, neardup.near_duplicates(docs).collect()))
        lines = sorted((repr((r["doc_id"], r["text"], r["_removed"])) for r in linededup.dedup_lines(docs).collect()))
        kept = sorted(repr((r["doc_id"], r["text"])) for r in neardup.distinct_documents(docs).collect())
        scores = sorted(repr((r["doc_id"], round(r["_score"], 9))) for r in quality.classify(docs, labels).collect())
        return near, lines, kept, scores

    before = results()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert not common.small(1) and results() == before


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from quire.llm import common

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    fake = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError):
        common.shared_folder(fake)


def test_pairs_of_a_token_are_made_in_few_pieces_and_told_apart_by_parity_first():
    import numpy as np

    from quire.llm import setjoin

    rng = np.random.default_rng(5)
    # one long run among short ones: it took an array for each distance
    stop = np.minimum(np.arange(6_000) + rng.integers(1, 4, 6_000), 6_000)
    stop[:500] = 3_000
    pieces = list(setjoin.reached(stop))
    pairs = np.concatenate([i << 32 | j for i, j in pieces])
    want = np.concatenate([i << 32 | np.arange(i + 1, stop[i]) for i in range(6_000)])
    assert len(pieces) < 50 and np.array_equal(np.sort(pairs), np.sort(want))
    size = np.sort(np.concatenate([rng.integers(1, 70, 280), rng.integers(52_000, 65_536, 15), np.full(5, setjoin.LONG)]))
    place = np.minimum(rng.integers(0, 9, 300), size - 1)
    index, e, bits = rng.random(300) < 0.6, np.arange(300).astype(np.uint64) // 2, rng.integers(0, 1 << 10, 300).astype(np.uint64)
    a, b = np.triu_indices(300, 1)
    got = set(zip(*(x.tolist() for x in setjoin.fitting(size, place, index, bits, e, a, b, 80, 100))))
    for i, j in zip(a.tolist(), b.tolist()):
        m, n = int(size[i]), int(size[j])
        least = -(-(m + n) * 80 // 180)
        long = n == setjoin.LONG and m * 100 // 80 >= setjoin.LONG
        near = n * 80 <= m * 100 and min(m - int(place[i]), n - int(place[j])) + setjoin.SHARED - 1 >= least and (index[i] or (index[j] and m == n))
        parity = int(bits[i] ^ bits[j]).bit_count() <= m + n - 2 * least
        assert ((i, j) in got) == bool((long or (near and parity)) and e[i] != e[j])
