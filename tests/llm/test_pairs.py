"""Near-duplicates, substring dedup and decontamination against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import components, decontam, minhash, substrings


def shingles(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_classes(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        p = rng.randrange(len(words))
        if rng.random() < 0.3:
            del words[p]
        else:
            words[p] = f"e{rng.randrange(10_000)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows, at = [], 0
    for _ in range(25):  # groups with hubs and outsiders at every distance
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((at, " ".join(edited(rng, base, rng.randrange(0, max(2, len(base) // 18))))))
            at += 3
    rows += [(5000, ""), (5001, None), (5002, "one two"), (5003, "ONE\ttwo"), (5004, "one two three"), (5005, "Ä b c d e"), (5006, "ä b c d e"), (5007, "a b c d"), (5008, "a b c d")]
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_classes_equal_brute_force(spark, corpus, width):
    docs = spark.createDataFrame([(i, t, "c") for i, t in corpus], "doc_id long, text string, component_id string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == brute_classes(corpus, width, 80)


@pytest.mark.parametrize("meet, groups", [(2048, 1000), (7, 1000), (7, 3), (2048, 2)])
def test_cross_join_misses_no_pair(spark, monkeypatch, meet, groups):
    own = F.when(F.col("cls") % 5 < 4, F.col("cls") % groups).otherwise(F.lit(0))
    rng = random.Random(2)
    base = [rng.randrange(10**6) for _ in range(100)]
    rows = []
    for i in range(60):
        s = set(rng.sample(base, rng.randrange(82, 101))) | {rng.randrange(10**6) for _ in range(rng.randrange(25))}
        rows.append((i, sorted(s)))
    sets = spark.createDataFrame(rows, "cls long, items array<long>")
    docs = sets.select("cls", F.size("items").cast("long").alias("n"), own.alias("own"))
    monkeypatch.setattr(minhash, "MEET", meet)
    got = {tuple(sorted(r)) for r in minhash._verified(minhash._cross(docs, sets, 80), sets, 80).collect()}
    s = {i: set(x) for i, x in rows}
    of = lambda i: i % groups if i % 5 < 4 else 0
    want = {(a, b) for a in s for b in s if a < b and of(a) != of(b) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])}
    assert got == want and want


def test_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "z z"), (None, "Z z")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert rows == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in minhash.keep_first(docs).collect()) == [(0, ""), (0, "z z"), (1, "a b c d e f")]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0 and minhash.keep_first(docs.limit(0)).count() == 0


def brute_rows(rows, width, percent):
    """(component id of each row, rows that stay) where ids may repeat: text components by plain comparison of all rows."""
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    links = [(x, y) for x in range(len(rows)) for y in range(x) if near(sets[x], sets[y])]

    def spread(links, label):
        changed = True
        while changed:
            changed = False
            for x, y in links:
                m = min(label[x], label[y])
                changed |= label[x] != m or label[y] != m
                label[x] = label[y] = m
        return label

    text = spread(links, label[:])
    whole = spread(links + [(x, y) for x in range(len(rows)) for y in range(x) if sets[x] and sets[y] and rows[x][0] == rows[y][0]], label[:])
    least = {}
    for (i, _), s, w in zip(rows, sets, whole, strict=True):
        if s:
            least[w] = min(least.get(w, i), i)
    stay, seen = [], set()
    for x in sorted(range(len(rows)), key=lambda x: rows[x][0]):
        if text[x] not in seen or not sets[x]:
            stay.append(rows[x])
            seen.add(text[x])
    return [least[w] if s else i for (i, _), s, w in zip(rows, sets, whole, strict=True)], stay


def test_ids_with_several_texts_lose_nothing(spark):
    rng = random.Random(41)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (5, a), (5, b), (6, b + " x"), (7, c), (7, c), (8, d), (8, e), (9, d + " y"), (10, text()), (3, ""), (3, ""), (11, e + " q")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, __id string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, 4).collect())
    names, stay = brute_rows(rows, 4, 80)
    assert got == sorted(zip([i for i, _ in rows], names, strict=True))
    kept = minhash.keep_first(docs, 4)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(stay)
    assert {b, e} <= {t for _, t in stay}


def test_very_long_texts_are_compared_whole(spark):
    long = " ".join(f"w{k % 7001}_{k % 31}" for k in range(120_000))
    rows = [(1, long), (2, long + " tail"), (3, " ".join(reversed(long.split()))), (4, "x" * 500_000), (5, "x" * 500_001)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows, 5, 80)


def test_signature_collides_as_the_sets_do():
    rng = np.random.default_rng(3)
    for n in (3, 40, 1000):
        hits = total = 0
        for _ in range(60):
            pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = np.unique(pool[: n + n // 2]), np.unique(pool[n // 2 :])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            hits += (minhash.signature(a) == minhash.signature(b)).mean() - j
            total += 1
        assert abs(hits / total) < 0.06, n


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(20)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- substrings ----------------------------------------------------------------

PASSAGE = "The first planted sentence has some words in it. Another one follows here, longer than the first by far and away. And a third one closes the passage with a few more words than needed for the test to pass at all."


def plain_parts(text, longest=8):
    """(words, start, end, whether a sentence ends) of each part, cut by the rule as the docstring states it, word by word."""
    found = [(m.start(), m.end()) for m in re.finditer(r"\S+", text) if re.search(r"[A-Za-z0-9\u0080-\U0010ffff]", m.group())]
    if not found:
        return []
    stops = [b for b, _ in found[1:]] + [len(text)]
    words, closes = [], []
    for (a, _), stop in zip(found, stops, strict=True):
        own = text[a:stop]
        tail = max(k for k, c in enumerate(own) if c.isalnum() or c > "\x7f") + 1
        words.append(own.split()[0].lower())
        closes.append(any(c in ".!?\n" for c in own[tail:]))
    key = [(not c, int(v) >> 1) for c, v in zip(closes, word_hashes(words), strict=True)]
    cuts = {k for k, c in enumerate(closes) if c} | {len(words) - 1}
    for k in range(len(words) - longest + 1):
        cuts.add(min(range(k, k + longest), key=lambda x: (key[x], x)))
    out, first = [], 0
    for c in sorted(cuts):
        out.append((tuple(words[first : c + 1]), found[first][0], stops[c], closes[c] or c == len(words) - 1))
        first = c + 1
    return out


def word_hashes(words):
    from lodestone.llm import arrowtext as at

    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = at.words(data, np.array([0, len(data)]))
    return at.word_hashes(data, starts, ends, at.byte_codes(fold=False))


def plain_spans(text, run=4, words=20):
    """(words, start, end) of every span, by trying every run of parts."""
    s, out = plain_parts(text or ""), set()
    long = lambda a, b: sum(p[3] for p in s[a : b + 1]) >= run or sum(len(p[0]) for p in s[a : b + 1]) >= words
    for a in range(len(s)):
        b = next((b for b in range(a, len(s)) if long(a, b)), None)
        if b is not None:
            out.add((a, b))
    last = next((a for a in reversed(range(len(s))) if long(a, len(s) - 1)), None)
    if last is not None:
        out.add((last, len(s) - 1))
    return [(tuple(w for p in s[a : b + 1] for w in p[0]), s[a][1], s[b][2]) for a, b in sorted(out)]


def brute_cut(rows):
    """Every span, as words, held against all earlier ones."""
    first, occ = {}, []
    for i, t in sorted(rows):
        for words, a, b in plain_spans(t):
            if words in first:
                occ.append((i, a, b))
            else:
                first[words] = i
    out = {}
    for i, t in rows:
        drop = [False] * len(t or "")
        for j, a, b in occ:
            if j == i:
                drop[a:b] = [True] * (b - a)
        out[i] = t if t is None else "".join(c for c, d in zip(t, drop, strict=True) if not d)
    return out


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(9)
    filler = lambda: " ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) + ". "
    rows = [(i, filler() + PASSAGE + " " + filler()) for i in range(6)] + [(10, filler() + filler()), (11, None), (12, ""), (13, "short. text."), (14, PASSAGE + "\n" + PASSAGE)]
    rows += [(15, "One two. Three four! Five six? Seven eight."), (17, "A line of words. Shared. By all."), (18, filler() + "A line of words. Shared. By all. " + filler()), (17, "A line of words. Shared. By all."), (18, filler() + "A line of words. Shared. By all. " + filler()), (16, filler() + "One two. Three four! Five six? Seven eight.\n" + filler())]
    rows += [(20 + i, filler() + " ".join(f"n{k}" for k in range(120)) + " " + filler()) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, start string")
    out = {r["doc_id"]: r["text"] for r in substrings.remove_repeated(docs).collect()}
    assert out == brute_cut(rows)
    assert PASSAGE in out[0] and all(PASSAGE[:60] not in out[i] for i in range(1, 6)) and out[10] == dict(rows)[10] and out[11] is None
    assert out[18] == dict(rows)[18] and "Five six" in out[15] and "Five six" not in out[16]
    assert all("n60 n61 n62" not in out[20 + i] for i in (1, 2))


def test_substring_edge_cases(spark):
    docs = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert sorted(len(r["text"]) for r in substrings.remove_repeated(docs).collect()) == [0, len(PASSAGE), len(PASSAGE)]
    assert substrings.remove_repeated(docs.limit(0)).count() == 0
    for t in (PASSAGE, "a.b. c\n\n d!? e", "...", "x " * 100):
        covered = "".join(t[a:b] for a, b, *_ in substrings.units(t))
        assert t.endswith(covered) and not any(c.isalnum() for c in t[: len(t) - len(covered)])


def held_before(rows, n):
    """(id, first word) of each run of n words that an earlier document holds, by plain windows."""
    first, runs = {}, []
    for i, t in sorted(rows):
        w = t.lower().split()
        for a in range(len(w) - n + 1):
            if first.setdefault(tuple(w[a : a + n]), i) != i:
                runs.append((i, a))
    return runs


def left_whole(rows, out, n=51):
    """The runs of ``held_before`` of which the cut text still has every word."""
    texts = dict(rows)
    return [(i, a) for i, a in held_before(rows, n) if " ".join(texts[i].lower().split()[a : a + n]) in " ".join(out[i].lower().split())]


def test_no_run_of_51_words_stays_whole(spark):
    rng = random.Random(31)
    word = lambda: f"q{rng.randrange(10**6)}"
    rare = [w for w in (f"r{k}" for k in range(4000)) if zlib.crc32(w.encode()) % 8]
    passages = [[rng.choice(rare) for _ in range(51)] for _ in range(6)]
    for at in (10, 16, 17, 30):  # sentence ends at every distance from the passage's own
        passages += [[w + "." * (k in (at, at + 18, 41)) for k, w in enumerate(word() for _ in range(51))] for _ in range(5)]
    passages.append(["same"] * 51)
    rows = []
    for p in passages:
        for _ in range(3):
            before, after = ([word() for _ in range(rng.randrange(20))] for _ in range(2))
            rows.append((len(rows), " ".join(before + p + after) + rng.choice(["", " End."])))
    runs = held_before(rows, 51)
    assert len({i for i, _ in runs}) == 2 * len(passages)
    out = {r["doc_id"]: r["text"] for r in substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left_whole(rows, out) == []


def test_texts_without_id_or_of_one_id_count_against_one_another(spark):
    rows = [(i, f"{tag} opens this row. " + PASSAGE) for i, tag in [(None, "aa"), (None, "bb"), (7, "cc"), (7, "dd")]]
    cuts = lambda part: sorted((r["doc_id"] or 0, PASSAGE[40:160] in r["text"]) for r in substrings.remove_repeated(spark.createDataFrame(part, "doc_id long, text string")).collect())
    assert cuts(rows[:2]) == [(0, False), (0, True)]
    assert cuts(rows[2:]) == [(7, False), (7, True)]
    assert cuts(rows) == [(0, False), (0, False), (7, False), (7, True)]


def test_units_stand_alike_in_any_case_and_blank():
    assert [h for h, *_ in substrings.spans(PASSAGE.replace("first", "\u00c4RGER"))] == [h for h, *_ in substrings.spans(PASSAGE.upper().replace("FIRST", "\u00e4rger").replace(" ", "\u00a0"))]
    assert max(n for *_, n in substrings.units("w " * 40 + PASSAGE)) <= 8


def test_substring_columns_of_any_name_and_very_long_texts(spark):
    long = " ".join(f"w{k % 9973}_{k % 17}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long, 5, "a", "b"), (2, "short tail. " + long, 6, "c", "d")], "doc_id long, text string, __id int, __th string, __cut string")
    got = substrings.remove_repeated(docs)
    assert got.columns == [*docs.columns, "__cut_"]
    out = {r["doc_id"]: r for r in got.collect()}
    assert out[1]["text"] == long and len(out[2]["text"].split()) <= 2 + 8 and out[2]["text"].startswith("short tail.") and (out[2]["__id"], out[2]["__cut"]) == (6, "d")


# --- decontamination -------------------------------------------------------------


def levenshtein_within(item, ids):
    """Least edits of item to any stretch of ids."""
    prev = [0] * (len(ids) + 1)
    for i, v in enumerate(item, 1):
        cur = [i] + [0] * len(ids)
        for j, w in enumerate(ids, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (v != w))
        prev = cur
    return min(prev)


def test_edited_items_are_found(spark):
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([16, 20, 33, 45, 59, 5, 1])] + [(90, ""), (91, None)]
    docs = [(0, None), (1, ""), (2, " ".join(rng.choice(vocab) for _ in range(3000)))]
    for n in range(120):
        k = rng.randrange(5)
        w = items[k][1].split()
        e = edited(rng, w, rng.randrange(0, int(len(w) * 0.26)))
        docs.append((10 + n, " ".join([rng.choice(vocab) for _ in range(40)] + e + [rng.choice(vocab) for _ in range(40)])))
    found = decontam.pairs(decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=3)).collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in found}
    want = {}
    for i, t in docs:
        for k, item in items:
            w = decontam.words(item)
            if w and t:
                d = levenshtein_within(w, decontam.words(t))
                if d <= decontam.edits_allowed(len(w), 0.8):
                    want[i, k] = d
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and len(want) > 80
    assert all(got[p] == want[p] for p in got if want[p] == 0)


def test_every_place_is_reported(spark):
    rng = random.Random(77)
    vocab = [f"v{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, other = text(25), text(18)
    near = item.split()
    near[4], near[11] = "xx", "yy"
    docs = {
        1: f"{item} {item}", 2: f"{text(9)} {item} {text(60)} {item} {text(3)} {item}", 3: " ".join([*near, item, *near]),
        4: f"{item} {' '.join(near)} {other} {item}", 5: text(500), 6: " ".join([item] * 400), 7: "v1 " * 30_000,
    }
    tables = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame([(1, item), (2, other), (3, "v1 " * 20)], "item_id long, text string")
    found = decontam.find(*tables).collect()
    count = {}
    for r in found:
        count[r["doc_id"], r["item_id"]] = count.get((r["doc_id"], r["item_id"]), 0) + 1
        w = decontam.words(docs[r["doc_id"]])[r["first_word"] : r["stop_word"]]
        assert r["edits"] == levenshtein_within(decontam.words([item, other, "v1 " * 20][r["item_id"] - 1]), w)
    assert count == {(1, 1): 2, (2, 1): 3, (3, 1): 3, (4, 1): 3, (4, 2): 1, (6, 1): 400, (7, 3): 1500}
    for key in count:
        at = sorted((r["first_word"], r["stop_word"]) for r in found if (r["doc_id"], r["item_id"]) == key)
        assert all(a[1] <= b[0] for a, b in zip(at, at[1:], strict=False))


def test_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten y", "a"), (2, "one two three other words entirely here", "b"), (3, None, "c"), (None, "", "d")], "doc_id long, text string, edits string")
    assert sorted(r["edits"] for r in decontam.keep_clean(docs, items).collect()) == ["b", "c", "d"]
    assert decontam.keep_clean(docs, items.limit(0)).count() == 4 and decontam.find(docs.limit(0), items).count() == 0
