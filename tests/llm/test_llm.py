"""The operators of the llm subpackage against brute force on small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestry.llm import decontam, langid, licences, lm, media, minhash, mix, secret_scan, shard, urls
from attestry.llm.common import id_remainder
from attestry.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(rf"[^{SPACE}]+", lower(t))


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = frame(spark, [(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, "  x\x1cy Z", "en", "src1", 3), (None, "no id here at all", "en", "src1", 9),
                        (9004, "same row twice here now", "en", "src2", 1), (9004, "same row twice here now", "en", "src2", 1), (9005, "12 34 !!", "de", "src3", 2)])
    return docs.unionByName(odd).withColumn("component", F.lit("clash")).withColumn("key", F.lit(1))


def test_words_follow_the_definition(spark):
    import numpy as np
    import pyarrow as pa

    from attestry.llm.words import pieces, words as prints

    texts = ["The  cat\tSAT", "", None, "cat\x0bsat the", "é É x", " lead and trail "]
    seen = {}
    for first, last, data, cuts in pieces(pa.array(texts), size=8):
        hashes, starts = prints(data, cuts)
        for row in range(first, last):
            own = hashes[starts[row - first] : starts[row - first + 1]]
            assert len(own) == len(words(texts[row]))
            for h, w in zip(own, words(texts[row]), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(map(int, np.array(list(seen.values()))))) == len(seen)


def test_lm_base_is_exact_and_score_follows_the_counts(spark, corpus):
    s = lm.Settings(max_filter_bytes=1 << 22, hot_words=16, flush_tokens=5000, bucket_bytes=1 << 16)
    got = lm.score(corpus, id_remainder("doc_id", 7) == 2, s).collect()
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want[(i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_levels_come_back_from_probes():
    import numpy as np

    s = lm.Settings()
    keys = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 4001) % 50 + 1
    bits = 1 << 20
    field = np.zeros(bits, dtype=bool)
    levels = lm._levels(counts, s.base)
    for level in range(1, levels.max() + 1):
        for place in lm._places(keys[levels >= level], level, s.probes, 1, bits):
            field[place] = True
    row = {"bucket": 0, "bits": np.packbits(field, bitorder="little").tobytes(), "tokens": 1, "distinct_words": 1, "entries": 1, "hot_keys": b"", "hot_counts": b""}
    model = lm.Filter([row], 1, bits, s)
    got = model.counts(keys)
    low, high = s.base ** (levels - 1), s.base**levels
    assert np.mean((got >= np.floor(low)) & (got <= high)) > 0.99
    assert np.mean(model.counts(keys + np.uint64(1)) > 0) < 0.05


def test_lm_without_training_rows_and_empty(spark):
    empty = frame(spark, [])
    assert lm.score(empty, F.lit(False)).count() == 0
    one = lm.score(frame(spark, [(1, "a b", "en", "s", 3)]), F.lit(True)).first()
    assert (one["train_tokens"], one["n_known"], one["base_score"]) == (0, 0, 0.0)


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            sets.setdefault(i, set()).update([frozenset({tuple(w)})] if 0 < len(w) < 5 else [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))] if w else [])
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def variants(spark):
    """Near copies of all degrees around the threshold, chains, equal sets and short texts."""
    import random

    rng = random.Random(3)
    rows, vocab = [], [f"w{k}" for k in range(400)]
    for base in range(6):
        text = [rng.choice(vocab) for _ in range(rng.choice([40, 80, 160]))]
        for k in range(30):
            copy = list(text)
            for _ in range(k // 3):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((base * 100 + k, " ".join(copy), "en", "s", 1))
        chain = list(text)
        for k in range(10):
            chain = chain[2:] + [rng.choice(vocab), rng.choice(vocab)]
            rows.append((base * 100 + 50 + k, " ".join(chain), "en", "s", 1))
    rows += [(9000 + k, t, "en", "s", 1) for k, t in enumerate(["a b", "A  b", "a b c", "", None, "x", "a b"])]
    return rows


@pytest.mark.parametrize("most", [1, 12])
def test_minhash_finds_the_components_of_brute_force(spark, most):
    rows = variants(spark)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows), most=most).collect()}
    want = brute_groups([(r[0], r[1]) for r in rows])
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert got[9003]["n_shingles"] == got[9004]["n_shingles"] == 0 and got[9000]["n_shingles"] == 1


def test_minhash_on_the_corpus_and_empty(spark, corpus):
    got = minhash.near_duplicates(corpus).collect()
    want = brute_groups([(r["doc_id"], r["text"]) for r in corpus.collect()])
    assert len(got) == corpus.count()
    assert all(r["kept"] and r["component_id"] is None if r["doc_id"] is None else r["component_id"] == want[r["doc_id"]] for r in got)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(frame(spark, links, "u long, v long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert components(frame(spark, [], "u long, v long")).count() == 0


def simulated(counts, weights):
    """Earliest deadline first, slot by slot, phase by phase."""
    left, out = dict(counts), []
    while any(left.values()):
        active = {s: w for s, w in weights.items() if left[s] and w} or {s: 1 for s in weights if left[s]}
        q, served, t = sum(active.values()), dict.fromkeys(active, 0), 0
        while all(left[s] for s in active):
            ready = [(-(-(served[s] + 1) * q // w), list(weights).index(s), s) for s, w in active.items() if served[s] * q // w <= t]
            pick = min(ready)[2]
            served[pick] += 1
            left[pick] -= 1
            t += 1
            out.append(pick)
            for s, w in active.items():
                assert abs(served[s] - t * w / q) < 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 500, "b": 90, "c": 33, "*": 41}, {"a": 7, "b": 0, "c": 300, "*": 1}])
def test_mixing_is_the_simulated_schedule(spark, sizes):
    weights, block = {"a": 5, "b": 3, "c": 2, "*": 1}, 4
    rows, k = [], 0
    for s, n in sizes.items():
        for j in range(n):
            rows.append((k, "t", "en", s if s != "*" else [None, "zz"][j % 2], 1))
            k += 1
    got = mix.mixed(frame(spark, rows), ["doc_id"], "source", weights, block_rows=block, per_bucket=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(k)) and sorted(r["position"] for r in got) == list(range(k))
    by_slot = {}
    for r in got:
        by_slot.setdefault(r["slot"], set()).add(r["source"] if r["source"] in weights else "*")
    want = simulated({s: -(-n // block) for s, n in sizes.items()}, weights)
    assert [by_slot[s] for s in range(len(want))] == [{s} for s in want]
    order = [r["slot"] for r in sorted(got, key=lambda r: r["position"])]
    assert order == sorted(order)


def test_mixing_keeps_repeated_rows_and_empty_tables(spark, corpus):
    got = mix.mixed(corpus, ["doc_id"], "source", {"src0": 2, "src1": 1})
    assert sorted(r["position"] for r in got.collect()) == list(range(corpus.count()))
    assert mix.mixed(frame(spark, []), ["doc_id"], "source", {"a": 1}).count() == 0


def test_licences_and_inheritance(spark):
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/b/x.txt", "nothing"), (3, "r/a/LICENSE", "Intro\nLicensed under the Apache License, Version 2.0.\n"),
            (4, "r/a/b/y.txt", "This work is licensed under the GNU General Public License, version 3."), (5, "q/z.txt", None), (6, None, ""), (2, "r/a/b/x.txt", "nothing"),
            (7, "r/c/n.txt", "a licensed plumber came by and fixed the kitchen sink for a fair price"), (8, "top.txt", "x")]
    got = {(r["doc_id"]): (r["licence"], r["origin"], r["inherited_from"]) for r in licences.licensed(frame(spark, rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "r/a"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None), 5: (None, "none", None),
                   6: (None, "none", None), 7: ("MIT", "inherited", "r"), 8: (None, "none", None)}
    assert licences.licensed(frame(spark, [], "doc_id long, path string, text string")).count() == 0


def _licence_by_brute_force(texts, least):
    """Licence and cosine of each text from every passage at every place, with weights counted here."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    words = [split(t) for t in texts]
    ix = licences.index(len(texts), Counter(w for own in words for w in set(own)), least)
    weight = lambda own: {w: k * (math.log((len(texts) + 1) / (sum(w in x for x in map(set, words)) * (w in ix.idf) + 1)) + 1) for w, k in Counter(own).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best, unfiltered = [], []
    for own in words:
        ends = [(0.0, "")]
        every = [(0.0, "")]
        for t, (name, template) in enumerate(licences.TEMPLATES):
            other = split(template)
            b = weight(other)
            padded = [f"-{i}" for i in range(len(other))] + own + [f"+{i}" for i in range(len(other))]
            for s in range(1 - len(other), len(own)):
                a = weight(padded[s + len(other) : s + 2 * len(other)])
                cosine = round(sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b), 9)
                if cosine >= least:
                    every.append((-cosine, name))
                    if any(0 <= s + i < len(own) and own[s + i] == w for w, places in ix.places.items() for k, i in places if k == t):
                        ends.append((-cosine, name))
        best.append(min(ends))
        unfiltered.append(min(every))
    return best, unfiltered


def test_licences_against_brute_force(spark):
    gpl = next(t for n, t in licences.TEMPLATES if n == "GPL-3.0" and "redistribute" in t)
    gpl2 = next(t for n, t in licences.TEMPLATES if n == "GPL-2.0" and "redistribute" in t)
    mit = next(t for n, t in licences.TEMPLATES if n == "MIT" and "Permission" in t)
    wrap = lambda t, n, mark: "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    prose = "the mill on the hill kept its old wheel turning while the version of the story that people told was free to change "
    texts = [
        "Copyright 2020 X\n" + wrap(gpl, 6, " * ") + "\nint main() {}", prose + wrap(gpl2, 5, "# ") + " " + prose, prose + mit + ". " + prose * 3, prose * 4,
        prose + "released under the MIT licence " + prose, prose + "Released under the\n// MIT License. " + prose, "SPDX-License-Identifier: MPL-2.0", "// SPDX-License-Identifier: ISC",
        gpl.replace("Free Software Foundation", "Free Sofware Foundaton"), "License", "MIT License", "under the MIT License " * 3, "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", None, "", "Version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n" + prose, "GNU Lesser General Public License, version 3", "this work is licensed under the gnu general public license"]
    rows = [(i, f"d{i}/x", t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["licence"], r["cosine"]) for r in licences.licensed(frame(spark, rows, "doc_id long, path string, text string")).collect()}
    best, unfiltered = _licence_by_brute_force(texts, 0.75)
    assert [n for _, n in best] == [n for _, n in unfiltered]  # the index loses no licence
    for i, (cosine, name) in enumerate(best):
        assert (got[i][0] or "") == name and abs((got[i][1] or 0.0) + cosine) < 1e-6, (i, texts[i], got[i], cosine, name)
    assert [got[i][0] for i in (0, 1, 2, 3, 5, 6, 8, 12, 13, 17)] == ["GPL-3.0", "GPL-2.0", "MIT", None, "MIT", "MPL-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "GPL-2.0"]


def test_licences_in_long_texts_and_with_clashing_columns(spark):
    long = "copy the license of the software under version 2 " * 40_000 + "Released under the MIT License"
    rows = [(1, "a/LICENSE", long, "x", 1), (None, None, "Released under the MIT License", "y", 2), (None, None, "Released under the MIT License", "y", 2)]
    got = licences.licensed(frame(spark, rows, "doc_id long, path string, text string, line string, word int"))
    assert sorted((str(r["doc_id"]), r["licence"], r["origin"]) for r in got.collect()) == [("1", "MIT", "own"), ("None", "MIT", "own"), ("None", "MIT", "own")]


ITEM = "If Alice buys 12 apples and then, Bob sells 5 kg of flour at the market before noon, how many apples does, Alice keep for her long winter stay"
BENCH = "item_id long, text string"


def verdicts(spark, rows, items):
    return {r["doc_id"]: (r["verdict"], r["item_id"]) for r in decontam.decontaminated(frame(spark, rows), frame(spark, items, BENCH)).collect()}


def test_decontamination_catches_templates_and_checks_slots(spark):
    changed = ITEM.replace("Alice", "Carla").replace("Bob", "David").replace("12", "31").replace("5 kg", "8 miles")
    mixed_up = changed.replace("Carla keep", "David keep")
    other = "the river runs slowly past the old mill where nobody has lived for many years since the flood took the bridge away"
    rows = [(1, f"Some words before. {ITEM} and after", "en", "s", 1), (2, f"Intro text here. {changed}", "en", "s", 1), (3, f"Intro here. {mixed_up}", "en", "s", 1),
            (4, other, "en", "s", 1), (5, None, "en", "s", 1), (6, "", "en", "s", 1), (7, "short one", "en", "s", 1), (8, ITEM.split(",")[0], "en", "s", 1), (None, ITEM, "en", "s", 1)]
    got = verdicts(spark, rows, [(70, ITEM), (71, "short one"), (72, None), (73, "")])
    assert got[1] == ("verbatim", 70) and got[None] == ("verbatim", 70) and got[7] == ("verbatim", 71)
    assert got[2] == ("reparameterised", 70)
    assert all(got[k] == ("clean", None) for k in (3, 4, 5, 6, 8))


def test_decontamination_counts_verbatim_windows_whatever_the_slots(spark):
    tail = " while the old miller from the village counts every sack twice and writes the sum into a long grey book"
    number = "They had 12 sheep on the hill and also 12 goats behind the barn" + tail
    two = "In the spring, Alice walks to the lake and, Bob walks to the mill" + tail
    rows = [(1, number.replace("12 goats", "13 goats"), "en", "s", 1), (2, two.replace("Alice", "Bob"), "en", "s", 1), (3, "Some words and " + number, "en", "s", 1),
            (4, number.replace("12 goats", "13 goats")[:63], "en", "s", 1)]
    assert verdicts(spark, rows, [(80, number), (81, two)]) == {1: ("verbatim", 80), 2: ("verbatim", 81), 3: ("verbatim", 80), 4: ("clean", None)}


def test_decontamination_finds_short_items_anywhere(spark):
    items = [(90, "Which river crosses Bremen"), (91, "Which Saxon town has the oldest paper mill"), (92, "Tell me how many red boats lay in the small harbour then"), (93, "hours of rain fell over the hills"), (94, "seven green bottles")]
    cases = {90: 0, 91: 1, 92: 2, 93: 3, 94: 4}
    before = ("", "They all asked us, ", "He wrote down again ", "It ended. ", "After 12 ")
    rows = [(10 * i + k, f"{text}{items[n][1]} and nobody in the room could say", "en", "s", 1) for i, n in cases.items() for k, text in enumerate(before)]
    rows += [(1, "Which river crosses the town of Bremen and nobody could say it", "en", "s", 1), (2, "seven bottles, green", "en", "s", 1),
             (3, "He asked, Which Saxon town has the oldest stone mill and nobody could say", "en", "s", 1), (4, "say seven green bottles", "en", "s", 1)]
    got = verdicts(spark, rows, items)
    assert {k: v for k, v in got.items() if k > 9} == {10 * i + k: ("verbatim", i) for i in cases for k in range(5)}
    assert got[1] == got[2] == got[3] == ("clean", None) and got[4] == ("verbatim", 94)


def test_decontamination_against_brute_force(spark, corpus):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = Counter((r["doc_id"], r["verdict"] != "clean") for r in decontam.decontaminated(corpus, bench).collect())
    plain = lambda t: [w.lower() for w in re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", t or "")]
    items = [w for w in (plain(r["text"]) for r in bench.collect())]
    grams = [{tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} for w in items]
    want = Counter()
    for r in corpus.collect():
        w = plain(r["text"])
        own = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        want[(r["doc_id"], any(own & g for g in grams))] += 1
    assert got == want
    assert decontam.decontaminated(frame(spark, []), bench).count() == 0
    assert decontam.decontaminated(corpus, bench.limit(0)).filter("verdict <> 'clean'").count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def test_url_rules_and_mined_rules(spark):
    pages = [(1, "https://a.example.net/en/1"), (2, "http://EXAMPLE.net/de/1"), (3, "http://x.org/fr/9?q=1"), (4, "http://example.com/de/"), (5, "http://example.community/de/"), (6, None),
             (7, "no scheme"), (8, "http://net"), (9, "http://b.net/"), (10, "ftp://user@h.example.com:80/de/x#y"), (10, "ftp://user@h.example.com:80/de/x#y"), (11, "")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(frame(spark, pages, "page_id long, url string"), RULES, min_confidence=1.1).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("example.net", "/de/1", "net/", "block")
    assert got[3][2:] == ("org/fr/", "allow") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == got[7] == got[11] == ("", "", None, "allow") and got[8] == ("net", "", None, "allow") and got[9][2:] == ("net/", "block")
    assert got[10] == ("user@h.example.com:80", "/de/x", None, "allow")
    assert urls.judged(frame(spark, [], "page_id long, url string"), RULES).count() == 0


def test_mined_rules_are_those_of_brute_force(spark):
    from itertools import combinations

    rows = [(["a", "b", "x"], True), (["a", "b"], True), (["a", "c"], False), (["b", "c"], False), (["a", "b", "c"], True), (["c"], False), (["x"], True)] * 3
    got = {(tuple(sorted(r["antecedent"])), round(r["support"], 6), round(r["confidence"], 6)) for r in urls.mine(frame(spark, rows, "tokens array<string>, block boolean"), 0.1, 0.9).collect()}
    want = set()
    for n in (1, 2, 3):
        for s in combinations("abcx", n):
            hold = [b for t, b in rows if set(s) <= set(t)]
            if sum(hold) / len(rows) >= 0.1 and sum(hold) / len(hold) >= 0.9:
                want.add((s, round(sum(hold) / len(rows), 6), round(sum(hold) / len(hold), 6)))
    assert got == want
    mined = urls.mine(frame(spark, rows, "tokens array<string>, block boolean"), 0.1, 0.9)
    found = {r["url"] for r in urls.match(frame(spark, [("1", ["a", "b", "z"]), ("2", ["a", "z"]), ("3", ["x"]), ("4", [])], "url string, tokens array<string>"), mined).collect()}
    assert found == {"1", "3"}


def test_url_rules_that_add_nothing_or_fail_on_held_out_hosts_fall(spark):
    schema = "antecedent array<string>, support double, confidence double, filed string"
    mined = frame(spark, [(["a"], 0.5, 0.95, "a"), (["a", "b"], 0.4, 0.95, "b"), (["a", "c"], 0.2, 1.0, "c"), (["d"], 0.2, 1.0, "d"), (["e"], 0.2, 1.0, "e")], schema)
    left = urls.shortest(mined)
    assert sorted(tuple(r["antecedent"]) for r in left.collect()) == [("a",), ("a", "c"), ("d",), ("e",)]
    held = frame(spark, [(["a"], True)] * 9 + [(["a"], False), (["a", "c"], True), (["d"], True), (["d", "x"], False), ([], True)], "tokens array<string>, block boolean")
    got = {tuple(r["antecedent"]): r["precision"] for r in urls.proven(left, held, 0.9).collect()}
    assert got == {("a",): 10 / 11, ("a", "c"): 1.0}  # d is right once in two, e fits nothing


def test_url_verdicts_against_brute_force(spark):
    """Trackers sit below all hosts alike and are blocked there; the domain that the list names for one path teaches nothing."""
    from itertools import combinations

    rules = [(f"ads{n}.com", "/", "block") for n in range(9)] + [(f"{('fine', 'calm')[n % 2]}{n}.org", "/", "allow") for n in range(9)] + [("example.com", "/de/", "block")]
    listed = [f"http://ads{n}.com/track/{k}?{'uid=1&' if k % 2 else ''}s=2" for n in range(9) for k in range(3)] + [f"http://{('fine', 'calm')[n % 2]}{n}.org/{w}/{k}?s=1" for n in range(9) for k, w in enumerate(("news", "track", "blog"))]
    listed += [f"http://example.com/de/{w}?uid={w}" for w in ("x", "y")] * 3
    open_ = ["http://other.net/track/7?uid=3&s=1", "http://other.net/track/7?s=1", "http://example.com/en/1", "http://example.com/news/1", "http://other.net/?uid=5", None, ""]
    rows = list(enumerate(listed + open_))
    got = {r["page_id"]: (r["verdict"], r["mined_rule"]) for r in urls.judged(frame(spark, [(i, u, "x") for i, u in rows], "page_id long, url string, tokens string"), rules, 0.01, 0.9).collect()}

    def toks(u):
        hostname, _, rest = u.split("://")[1].partition("/")
        where, _, query = rest.partition("?")
        words = {"path:" + w for w in re.sub(r"\d+", "#", where).split("/") if w} | {"key:" + k.split("=")[0] for k in query.split("&") if k}
        return hostname, words, {"host:" + x for x in hostname.split(".")} | {"domain:" + ".".join(hostname.split(".")[-2:])}

    known = []
    for u in listed:
        hostname, words, _ = toks(u)
        h, p, verdict = max((r for r in rules if r[0] == hostname), key=len)
        known.append((hostname, words - {"path:" + x for x in p.split("/")}, verdict == "block"))
    held = [x for x in known if zlib.crc32(x[0].encode()) % 4 == 2]
    rest = [x for x in known if zlib.crc32(x[0].encode()) % 4 != 2]
    assert held and any(not b for _, _, b in held)
    every = {}
    for items in {c for _, w, _ in rest for n in range(1, len(w) + 1) for c in combinations(sorted(w), n)}:
        hits = [b for _, w, b in rest if set(items) <= w]
        if sum(hits) / len(rest) >= 0.01 and sum(hits) / len(hits) >= 0.9:
            every[items] = sum(hits) / len(hits)
    short = [i for i in every if not any(set(j) < set(i) and every[j] >= every[i] for j in every)]
    precise = lambda i: [b for _, w, b in held if set(i) <= w]
    final = [i for i in short if precise(i) and sum(precise(i)) / len(precise(i)) >= 0.9]
    assert final
    for i, u in rows[len(listed):]:
        fits = [r for r in final if u and set(r) <= toks(u)[1] | toks(u)[2]]
        assert (got[i][0] == "block") == bool(fits) == (got[i][1] is not None)
    at = len(listed)
    assert [got[at + k][0] for k in range(5)] == ["block", "allow", "allow", "allow", "block"]


BASE = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(t or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_secret_spans_and_ownership(spark, corpus):
    key = "Zx9" + "Q7w8E" * 5
    mine = frame(spark, [(1, "é😀 password=token: abcdef token='abcdefg' ok", "en", "o1", 1), (2, f"use {key} now AKIA{'B' * 16}", "en", "o1", 1), (3, f"{key}", "en", "o1", 1),
                         (4, "copied Example9Example9Example9 here", "en", "o1", 1), (5, "copied Example9Example9Example9 here", "en", "o2", 1), (6, None, "en", None, 1), (7, "a" * 24 + "AKIA1", "en", "o3", 1)])
    for docs in (mine, corpus.drop("component", "key")):
        got = secret_scan.scanned(docs, F.col("doc_id"), F.col("source")).collect()
        want = Counter((r["doc_id"], ",".join(base_spans(r["text"]))) for r in docs.collect())
        assert Counter((r["doc_id"], r["base_spans"]) for r in got) == want
        for r in got:
            assert set(filter(None, r["base_spans"].split(","))) <= set(filter(None, r["spans"].split(",")))
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [r["base_spans"].count(k) for k in ("assign", "access", "hex")]
    by = {r["doc_id"]: r for r in secret_scan.scanned(mine, F.col("doc_id"), F.col("source")).collect()}
    assert by[2]["spans"] == f"owned:4:{4 + len(key)},access:{9 + len(key)}:{29 + len(key)}" and by[3]["spans"] == f"owned:0:{len(key)}"
    assert by[4]["spans"] == "" and by[4]["n_example"] == 1 and by[5]["n_live"] == 0 and by[6]["spans"] == ""
    assert secret_scan.scanned(frame(spark, []), F.col("doc_id"), F.col("source")).count() == 0


def brute_vector(t, dims, n):
    import numpy as np

    table = langid._letters()
    text = "".join(chr(table[ord(c)]) if table[ord(c)] != langid.GAP else " " for c in t or "")
    text = " " + " ".join(text.split()) + " "
    total = np.zeros(dims)
    for k in range(len(text) - n + 1):
        v = np.ones(dims)
        for j in range(n):
            v = v * np.roll(langid._letter_vectors(np.array([ord(text[k + j])]), dims)[0], n - 1 - j)
        total += v
    return total


def test_hyperdimensional_bundles_and_labels(spark, corpus):
    import numpy as np
    import pyarrow as pa

    texts = ["Das ist ein Haus", "", None, "a", "12 !!", "Été  à la\nplage…", "ab", " x y "]
    rows = [v for _, _, vectors, _ in langid.bundles(pa.array(texts), 128, 3, size=20) for v in vectors]
    for t, v in zip(texts, rows, strict=True):
        want = brute_vector(t, 128, 3) if any(c.isalpha() for c in t or "") else v
        assert np.allclose(v, want), t
    docs = corpus.withColumn("held_out", id_remainder("doc_id", 4) == 2)
    prototypes = langid.profiles(docs.filter("not held_out"), "text", "lang")
    got = langid.predict(docs, "text", prototypes, [F.col("doc_id"), F.col("held_out"), F.col("lang"), F.col("text")]).collect()
    assert len(got) == corpus.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in got)
    tried = [r for r in got if r["held_out"] and r["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == r["lang"] for r in tried]) > 0.95
    none = langid.predict(docs, "text", langid.profiles(docs.filter("false"), "text", "lang"), [F.col("doc_id")])
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def feistel(x, n, seed):
    a, b = shard.sides(n)
    while True:
        left, right = divmod(x, b)
        for k in range(1, shard.ROUNDS + 1):
            add = int(hashlib.md5(f"{seed}:{k}:{right if k % 2 else left}".encode()).hexdigest()[:15], 16)
            left, right = ((left + add) % a, right) if k % 2 else (left, (right + add) % b)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1009])
def test_feistel_is_the_reference_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(shard.permuted(F.col("id"), n, 5)).collect()]
    assert got == [feistel(x, n, 5) for x in range(n)] and sorted(got) == list(range(n))


def test_shards_are_even_and_gapless(spark, corpus):
    got = shard.sharded(corpus, 7, 1).collect()
    total = corpus.count()
    assert len(got) == total
    by = {k: sorted(r["slot"] for r in got if r["shard"] == k) for k in range(7)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(r["row_number"] for r in got) == list(range(total))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in corpus.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = shard.sharded(corpus.repartition(5), 7, 1).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert key(got) == key(again)
    assert shard.sharded(frame(spark, [])).count() == 0


def test_chroma_search_finds_edited_texts_at_any_phase(spark):
    """Near copies (five-word sets at 0.75 or more) whose edits shift the rest by any number of bytes, against brute force over all shifts."""
    import numpy as np

    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 10))) for _ in range(400)]
    texts = {}
    for k in range(12):
        own = list(rng.choice(vocabulary, 300))
        texts[50 * k] = " ".join(own)
        for copy in range(3):
            edited = list(own)
            for place in rng.choice(300, 4, replace=False):
                edited[place] = str(rng.choice(vocabulary)) + "x" * int(rng.integers(0, 5))
            texts[50 * k + copy + 1] = " ".join(edited)
    clips = frame(spark, [(k, t.encode()) for k, t in texts.items()], "clip_id long, sound binary")
    got = {r["clip_id"]: r for r in media.aligned(clips, F.col("clip_id") % 50 == 0).collect()}
    prints = {k: media.fingerprint(np.frombuffer(t.encode(), dtype=np.uint8)) for k, t in texts.items()}

    def errors(a, b):
        return min(np.bitwise_count(x[: min(len(x), len(y))] ^ y[: min(len(x), len(y))]).mean() / 32 for s in range(-8, 9) for x, y in [(a[max(0, -s) :], b[max(0, s) :])])

    true = [(q, c) for q in texts if q % 50 == 0 for c in (q + 1, q + 2, q + 3) if errors(prints[q], prints[c]) <= 0.3]
    assert len(true) >= 30
    assert sum(got[q]["n_matches"] for q in texts if q % 50 == 0) >= 0.9 * len(true)
    assert np.mean([got[q]["best_class"] in (q + 1, q + 2, q + 3) for q in texts if q % 50 == 0]) >= 0.9


def test_chroma_search_checks_every_offset_with_a_vote(spark):
    """The offset with most votes has too short an overlap; another one with fewer votes aligns half of the recordings."""
    import numpy as np

    rng = np.random.default_rng(11)
    most, some, here, there = (rng.integers(0, 256, n * media.HOP).astype(np.uint8) for n in (56, 44, 30, 30))
    clips = frame(spark, [(0, np.concatenate((some, here, most)).tobytes()), (1, np.concatenate((most, some, there)).tobytes())], "clip_id long, sound binary")
    got = {r["clip_id"]: r for r in media.aligned(clips, F.col("clip_id") == 0).collect()}[0]
    assert (got["n_matches"], got["best_class"], got["best_offset"]) == (1, 1, 56 * media.HOP)


def test_equal_clips_without_frames_share_a_class(spark):
    rows = [(0, b"a short clip"), (5, b"a short clip"), (7, b"another one"), (8, b""), (9, b""), (10, None), (11, None), (None, b"a short clip"), (12, b"x" * 351), (13, b"x" * 351), (14, b"x" * 350)]
    got = {r["clip_id"]: (r["class_id"], r["n_frames"]) for r in media.aligned(frame(spark, rows, "clip_id long, sound binary"), F.col("clip_id") == 0).collect()}
    assert got == {0: (0, 0), 5: (0, 0), 7: (7, 0), 8: (8, 0), 9: (8, 0), 10: (10, 0), 11: (11, 0), None: (0, 0), 12: (12, 0), 13: (12, 0), 14: (14, 0)}


def test_chroma_prints_align_shifted_copies(spark):
    import numpy as np

    rng = np.random.default_rng(4)

    def song():
        notes = 220 * 2 ** (rng.integers(0, 24, 40) / 12)
        t = np.arange(800) / media.RATE
        return np.concatenate([128 + 100 * np.sin(2 * np.pi * f * t) for f in notes]).astype(np.uint8)

    songs = [song() for _ in range(6)]
    rows = [(k * 50, s.tobytes()) for k, s in enumerate(songs)]
    rows += [(1000 + k, s[64 * media.HOP :].tobytes()) for k, s in enumerate(songs)]
    rows += [(2001, songs[0].tobytes()), (2002, None), (2003, b""), (2004, b"\x80" * 5000), (None, songs[1].tobytes())]
    clips = frame(spark, rows, "clip_id long, sound binary")
    got = {r["clip_id"]: r for r in media.aligned(clips, F.col("clip_id") < 1000).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        assert got[k * 50]["best_class"] == 1000 + k and got[k * 50]["best_offset"] == -64 * media.HOP and got[k * 50]["n_matches"] >= 1
    assert got[2001]["class_id"] == 0 and got[2002]["n_frames"] == got[2003]["n_frames"] == 0 and got[2002]["class_id"] == 2002
    s = songs[0][:4000].astype(np.float32) - 128
    frames = np.stack([s[i : i + media.FRAME] for i in range(0, len(s) - media.FRAME + 1, media.HOP)])
    energy = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * np.hanning(media.FRAME))) @ media._folding()
    image = np.tile(energy / energy.sum(1, keepdims=True), 2)
    shape, y, h, w = media._filters()[4]
    want = [np.log((1e-6 + image[t : t + w, y : y + h // 2].sum()) / (1e-6 + image[t : t + w, y + h // 2 : y + h].sum())) for t in range(len(image) - media.WIDTH + 1)]
    level = [(v > -media.STEP) + int(v > 0) + (v > media.STEP) for v in want]
    bits = [int(c) >> (2 * (15 - 4)) & 3 for c in media.codes(image)]
    assert bits == [v ^ v >> 1 for v in level]
