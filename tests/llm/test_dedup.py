"""Line, byte-window, word-window and near-duplicate dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from turnloom.llm.common import Scratch
from turnloom.llm.components import components
from turnloom.llm.cuckoo import CuckooFilter
from turnloom.llm.lines import LineIndex, dropped, indexed, lines_removed
from turnloom.llm import near, suffixes
from turnloom.llm.near import near_duplicates, one_of_each
from turnloom.llm.substrings import COVER, PERIOD, repeats_removed
from turnloom.llm.substrings import without_repeats as without_words
from turnloom.llm.suffixes import blind_trie, deep_shallow, runs
from turnloom.llm.suffixes import without_repeats as without_bytes


def sha(x):
    return hashlib.sha256(x).hexdigest()


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(15, 60))) for _ in range(5)]
    out = []
    for d in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)[1]
        elif kind < 0.4 and out:
            w = r.choice(out)[1].split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        else:
            lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 5))]
            if r.random() < 0.5:
                lines.insert(r.randrange(len(lines) + 1), r.choice(passages))
            t = "\n".join(lines)
        out.append((d * 7 % 101, t))
    return out


def test_cuckoo_filter_inserts_deletes_and_round_trips():
    keys = [random.Random(1).getrandbits(64) - (1 << 63) + i for i in range(3000)]
    f = CuckooFilter.of(keys)
    assert all(k in f for k in keys)
    f = CuckooFilter.from_bytes(f.to_bytes())
    for k in keys[:1500]:
        assert f.delete(k)
    assert all(k in f for k in keys[1500:])
    assert sum(k in f for k in keys[:1500]) < 30
    small = CuckooFilter(8)
    while small.insert(random.getrandbits(64)):
        pass
    assert small.size == sum(map(len, small.buckets))


def brute_lines(rows):
    def keys(t):
        return [x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)}) for x in t.split("\n")]

    holders = {}
    for d, t in rows:
        for k in keys(t):
            holders.setdefault(k, set()).add(d)
    out = {}
    for d, t in rows:
        kept = [x for x, k in zip(t.split("\n"), keys(t), strict=True) if len(k) < 10 or d == min(holders[k])]
        out[d] = (t.count("\n") + 1, t.count("\n") + 1 - len(kept), sha("\n".join(kept).encode()))
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_lines_match_brute_force_and_can_be_undone(spark, table):
    rows = corpus(5) + [(200, "Same Line Here  \nother"), (201, "\tsame line here\nshort"), (202, "short\nsame line here")]
    docs = table(rows)
    index = LineIndex.empty(spark).insert(docs)
    assert got(dropped(docs, index, "kept_sha256 string")) == brute_lines(rows)
    first, second = table(rows[:30]), table(rows[30:])
    assert got(dropped(docs, indexed(docs), "kept_sha256 string")) == brute_lines(rows)
    parts = LineIndex.empty(spark, 2).insert(first).insert(second)
    assert got(dropped(docs, parts, "kept_sha256 string")) == brute_lines(rows)
    gone = {d for d, _ in rows[:20]} | {200}
    left = [(d, t) for d, t in rows if d not in gone]
    undone = parts.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    assert got(dropped(table(left), undone, "kept_sha256 string")) == brute_lines(left)
    again = undone.insert(table([(d, t) for d, t in rows if d in gone]))
    assert got(dropped(docs, again, "kept_sha256 string")) == brute_lines(rows)


def test_an_index_of_a_table_reads_it_once_and_writes_few_tables(spark, table, monkeypatch):
    written, write = [], Scratch.write

    def noted(self, df):
        written.append(set(df.columns))
        return write(self, df)

    monkeypatch.setattr(Scratch, "write", noted)
    rows = corpus(6)
    docs = table(rows)
    index = indexed(docs)
    # the postings, what each batch asks, what the second meets and its filters
    assert sum({"doc_id", "k1"} <= c for c in written) == 1
    assert len(written) == 5
    assert {r["gen"] for r in index.postings[0].select("gen").distinct().collect()} == {1, 2}
    assert got(dropped(docs, index, "kept_sha256 string")) == brute_lines(rows)
    left = [(d, t) for d, t in rows if d % 3]
    undone = index.delete(spark.createDataFrame([(d,) for d, _ in rows if not d % 3], "doc_id long"))
    assert got(dropped(table(left), undone, "kept_sha256 string")) == brute_lines(left)
    again = undone.insert(table([(d, t) for d, t in rows if not d % 3]))
    assert got(dropped(docs, again, "kept_sha256 string")) == brute_lines(rows)


def test_line_dedup_keeps_keys_whose_fingerprints_collide(spark, table):
    at, pair = {}, None
    for i in range(100_000):
        line = f"a line of number {i}"
        f, *buckets = CuckooFilter(17)._place(int.from_bytes(hashlib.md5(line.encode()).digest()[:8], "little", signed=True))
        if pair := (other := at.setdefault((f, *sorted(buckets)), line)) != line and (other, line):
            break
    first, second = pair
    rows = [(1, first), (2, second), (3, second), (4, first)]
    index = LineIndex.empty(spark, 0).insert(table(rows[:1])).insert(table(rows[1:2]))
    for gone, more in ((1, 2), (2, 3)):
        left = [r for r in rows[:2] if r[0] != gone] + [rows[more]]
        after = index.delete(spark.createDataFrame([(gone,)], "doc_id long")).insert(table([rows[more]]))
        assert got(dropped(table(left), after, "kept_sha256 string")) == brute_lines(left)
        assert after.state().count() == after.state().select("k1", "k2").distinct().count()
    # both gone: nothing of either stays in the filter
    none = index.delete(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert not any(any(r["filter"]) for r in none.shard_filters().collect())


def test_random_changes_of_many_lines_match_brute_force(spark, table):
    r = random.Random(17)
    lines = [f"a line of number {i}" for i in range(100_000)]
    text = lambda: "\n".join(r.choice(lines) for _ in range(r.choice([5, 300, 12_000])))
    held, index = {}, LineIndex.empty(spark, 1)
    for step in range(5):
        new = {d: text() for d in r.sample([d for d in range(40) if d not in held], 6)}
        before, index = index, index.insert(table(list(new.items())))
        held |= new
        if step:
            gone = r.sample(sorted(held), 3)
            index = index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
            held = {d: t for d, t in held.items() if d not in gone}
    assert index.bits > 1 and before.gen < index.gen
    assert got(dropped(table(list(held.items())), index, "kept_sha256 string")) == brute_lines(list(held.items()))
    keys = {}
    for x in index.state().collect():
        keys.setdefault((x["k2"] % (1 << 64) >> 7) & ((1 << index.bits) - 1), []).append(x["k1"])
    assert sum(map(len, keys.values())) == len({x for t in held.values() for x in t.split("\n")})
    filters = {x["shard"]: CuckooFilter.from_bytes(x["filter"]) for x in index.shard_filters().collect()}
    assert all(filters[s].size == len(own) and all(k in filters[s] for k in own) for s, own in keys.items())


def windows_gone(units, width):
    seen, out = {}, {}
    for d in sorted(units):
        u = units[d]
        mask = [False] * len(u)
        for i in range(len(u) - width + 1):
            k = u[i : i + width]
            if k in seen:
                mask[i : i + width] = [True] * width
            else:
                seen[k] = (d, i)
        out[d] = mask
    return out


def test_bytes_match_brute_force(table):
    rows = corpus(7) + [(300, "ab" * 400), (301, "x" * 500), (302, "ab" * 99)]
    units = {d: t.encode() for d, t in rows}
    masks = windows_gone(units, 100)
    want = {}
    for d, m in masks.items():
        kept = bytes(x for x, y in zip(units[d], m, strict=True) if not y)
        want[d] = (len(m), sum(m), sum(y and (i == 0 or not m[i - 1]) for i, y in enumerate(m)), sha(kept))
    assert any(x[1] for x in want.values())
    assert got(without_bytes(table(rows), "kept_sha256 string")) == want
    for large in (0, 2, 40):
        assert got(without_bytes(table(rows), "kept_sha256 string", large=large)) == want


def brute_bytes(rows):
    units = {d: t.encode() for d, t in rows}
    return {d: (len(m), sum(m), sum(y and (i == 0 or not m[i - 1]) for i, y in enumerate(m)), sha(bytes(x for x, y in zip(units[d], m, strict=True) if not y))) for d, m in windows_gone(units, 100).items()}


def test_runs_that_share_a_minimizer_in_great_number(table):
    r = random.Random(3)
    line = "".join(r.choice("abcdefgh ") for _ in range(110))
    rows = [(i, "".join(r.choice("xyz") for _ in range(9)) + str(i) + line + str(i % 70) + "".join(r.choice("uvw") for _ in range(90))) for i in range(300)]
    rows += [(400 + i, rows[i][1][5:]) for i in range(0, 40, 7)]
    want = brute_bytes(rows)
    assert sum(x[1] > 0 for x in want.values()) > 250
    for large in (20_000, 100, 3):  # the hot minimizers have 300 runs
        assert got(without_bytes(table(rows), "kept_sha256 string", large=large)) == want


def test_tries_and_quicksort_decide_what_is_equal(monkeypatch):
    r = random.Random(8)
    data = b"".join(bytes(r.choice(b"ab") for _ in range(90)) for _ in range(3)) * 2
    starts, groups = np.arange(len(data) - 100), np.zeros(len(data) - 100, np.int64)
    _, same = deep_shallow(data, starts, groups, 100)
    assert len(set(same.tolist())) < len(same)
    monkeypatch.setattr(suffixes, "blind_trie", lambda strings: [[i] for i in range(len(strings))])
    assert len(set(deep_shallow(data, starts, groups, 100)[1].tolist())) == len(same)
    monkeypatch.undo()
    monkeypatch.setattr(suffixes, "multikey", lambda words, starts, groups, depth: (np.arange(len(starts)), np.empty(0, np.int64), np.empty(0, np.int64)))
    assert len(set(deep_shallow(data, starts, groups, 100)[1].tolist())) == len(same)


def test_multikey_quicksort_orders_segments():
    r = np.random.default_rng(2)
    for n, kinds in ((0, 2), (1, 2), (700, 2), (700, 200), (3000, 5)):
        keys = r.integers(0, kinds, (n + 64,)).astype(np.uint64)
        starts, groups = r.permutation(n), r.integers(0, 4, n)
        order, first, size = suffixes.multikey(lambda at: keys[at], starts, groups, 16)
        row = [(groups[i], keys[starts[i]], keys[starts[i] + 8]) for i in order]
        assert row == sorted(row)
        runs_ = {f: k for f, k in zip(first.tolist(), size.tolist(), strict=True)}
        want, i = {}, 0
        while i < n:
            j = i
            while j < n and row[j] == row[i]:
                j += 1
            if j - i > 1:
                want[i] = j - i
            i = j
        assert runs_ == want


def test_parts_of_equal_windows_have_one_key():
    r = random.Random(5)
    data = bytes(r.choice(b"abc ") for _ in range(3000))
    data += data[700:1500]
    found = {}
    for windows in (8, 1):
        for h, place, first, count in zip(*(x.tolist() for x in runs(data)), strict=True):
            run = data[first : first + count + 99]
            seen = []
            for key, k, n in suffixes.parts(run, count, 100, windows):
                seen += range(k, k + n)
                for i in range(k, k + n):
                    assert found.setdefault((windows, run[i : i + 100]), key) == key
            assert seen == list(range(count))


def test_runs_cover_all_windows_once():
    data = bytes(random.Random(2).choice(b"abc ") for _ in range(5000)) + b"z" * 700
    h, place, first, count = runs(data)
    assert np.array_equal(np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]), np.arange(len(data) - 99))
    assert all(f + c - 1 <= p <= f + 68 for p, f, c in zip(place, first, count, strict=True))


def test_deep_shallow_sorts_and_names_equal_suffixes():
    r = random.Random(4)
    data = b"".join(bytes(r.choice(b"ab") for _ in range(r.choice([40, 120]))) for _ in range(4)) * 3
    starts = np.array([r.randrange(len(data) - 100) for _ in range(400)])
    groups = np.array([r.randrange(3) for _ in range(400)])
    order, same = deep_shallow(data, starts, groups, 100)
    keys = [(groups[i], data[starts[i] : starts[i] + 100]) for i in order]
    assert keys == sorted(keys)
    assert [same[i] == same[i + 1] for i in range(399)] == [keys[i] == keys[i + 1] for i in range(399)]
    strings = [bytes(r.choice(b"ab") for _ in range(7)) for _ in range(200)]
    assert [[strings[i] for i in leaf] for leaf in blind_trie(strings)] == [[x] * strings.count(x) for x in sorted(set(strings))]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_words_match_brute_force(table):
    rows = corpus(9) + [(300, "a b " * 40), (301, "c " * 100)]
    units = {d: tuple(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in rows}
    masks = windows_gone(units, 20)
    want = {d: (len(m), sum(m), sha(" ".join(w for w, y in zip(units[d], m, strict=True) if not y).encode())) for d, m in masks.items()}
    assert any(x[1] for x in want.values())
    assert got(without_words(table(rows), "kept_sha256 string")) == want
    texts = {r["doc_id"]: r["text"] for r in repeats_removed(table(rows)).collect()}
    assert {d: sha(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)).encode()) for d, t in texts.items()} == {d: x[2] for d, x in want.items()}


def test_word_windows_with_one_common_passage(table):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(400)]
    out = got(without_words(table(rows)))
    assert out[0][1] == 0
    assert all(out[i][1] == 25 for i in range(1, 400))


def brute_near(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()), t or ""
    ids = sorted(sets)
    links = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (x, s), (y, t) = sets[a], sets[b]
            if s == t or x and y and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for e in links[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        out[d] = (min(seen), len(links[d]))
    return out


def near_rows():
    r = random.Random(11)
    base = [f"v{r.randrange(5000)}" for _ in range(200)]
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 5])):
            w[r.randrange(len(w))] = f"u{r.randrange(9999)}"
        rows.append((d, " ".join(w[: r.choice([200, 200, 150])])))
    return rows + [(200 + d, t) for d, t in corpus(13)] + [(400, "a b"), (401, "a  b"), (402, "a c")]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_match_brute_force(table, block):
    rows = near_rows()
    assert got(near_duplicates(table(rows), block=block)) == brute_near(rows)


def test_one_of_each_class_stays(table):
    rows = near_rows()
    want = {d for d, (c, _) in brute_near(rows).items() if c == d}
    out = one_of_each(table(rows + rows[:5]))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_texts_that_share_an_id_are_each_judged(table):
    rows = near_rows()[:40] + [(7, "quite another text that nothing repeats"), (3, "x y"), (50, "x y"), (50, near_rows()[20][1] + " end"), (9, None), (9, "x y z")]
    nodes = sorted({(d, hashlib.md5((t or "").encode()).digest(), t or "") for d, t in rows})
    brute = brute_near([(i, t) for i, (_, _, t) in enumerate(nodes)])
    want = sorted((nodes[i][0], nodes[c][0], n) for i, (c, n) in brute.items())
    assert sorted(map(tuple, near_duplicates(table(rows + rows[:5])).collect())) == want
    left = sorted((nodes[i][0], nodes[i][2]) for i, (c, _) in brute.items() if c == i)
    assert sorted((r["doc_id"], r["text"] or "") for r in one_of_each(table(rows + rows[:5])).collect()) == left


def test_prefixes_are_shortened_until_the_recall_is_measured():
    d = near.floor_length()
    assert 1 - (1 - 0.8**d) ** near.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** near.TREES
    assert near.floor_length(0.8, 0.5) > d
    sure, some = (100_000, 0, 400), (100_000, 900, 1500)
    assert near.chosen_lengths({1: {8: sure}, 2: {8: some, 7: some, 6: sure}, 3: {8: some, 7: some, 6: some}, 4: {8: (9, 0, 0)}, 5: {}}, d) == {1: 8, 2: 6, 3: d, 4: d, 5: d}


def pairs_at(low, high, seed):
    """Texts in pairs whose similarity lies between the bounds, of five to 500 words."""
    r, out = random.Random(seed), []
    while len(out) < 400:
        n = r.choice([9, 12, 20, 40, 100, 300, 500])
        w = [f"a{r.randrange(10**9)}" for _ in range(n)]
        v = list(w)
        cut = r.randrange(n // 5 + 1)
        v = v[: n - cut] if r.random() < 0.5 else v[cut:]
        for _ in range(r.randrange(3)):
            v[r.randrange(len(v))] = f"b{r.randrange(10**9)}"
        a, b = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (w, v))
        if low <= len(a & b) / len(a | b) < high:
            out.append((" ".join(w), " ".join(v)))
    return out


def test_links_next_to_the_threshold_are_found(table):
    pairs = pairs_at(0.8, 0.85, 3)
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    out = got(near_duplicates(table(rows)))
    assert sum(out[2 * i + 1] == (2 * i, 1) for i in range(len(pairs))) >= 0.99 * len(pairs)


def test_longer_prefixes_tie_what_shares_them(spark, monkeypatch, table):
    rows = near_rows()
    monkeypatch.setattr(near, "chosen_lengths", lambda seen, floor: {c: 7 for c in range(100)})
    close = got(near_duplicates(table(rows)))
    brute = brute_near(rows)
    assert all(close[d][1] <= brute[d][1] for d in brute) and sum(close[d] == brute[d] for d in brute) > 0.8 * len(brute)
    monkeypatch.setattr(near, "prefix_keys", lambda labels, length: labels[..., 0].astype(np.uint64) * np.uint64(0) + np.arange(labels[..., 0].size, dtype=np.uint64).reshape(labels.shape[:-1]))
    assert sum(n for _, n in got(near_duplicates(table(rows))).values()) < sum(n for _, n in close.values())


def test_labels_meet_as_often_as_texts_are_alike():
    r = np.random.default_rng(6)
    for n, e in ((9, 1), (90, 10), (900, 100)):
        hits = []
        for _ in range(150):
            g = r.integers(0, 1 << 63, n + e).astype(np.uint64)
            hits.append((near.signature(np.sort(g[:n])) == near.signature(np.sort(g[e:]))).mean())
        assert abs(np.mean(hits) - (n - e) / (n + e)) < 0.02
    assert near.matched(np.array([[1, 2, 3, 4, 5, 6, 7, 8]]), np.array([[1, 2, 9, 4, 5, 6, 7, 8]])).tolist() == [2]


def test_a_group_of_near_copies_makes_few_rows(spark, table):
    r = random.Random(5)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for d in range(1500):
        w = list(base)
        w[r.randrange(100)] = f"u{d}"
        rows.append((d, " ".join(w)))
    rows.append((1500, rows[7][1]))
    out = got(near_duplicates(table(rows)))
    assert {c for c, _ in out.values()} == {0}
    brute = brute_near(rows[:150])
    some = got(near_duplicates(table(rows[:150]), block=20))
    assert some == brute


def test_components_of_a_long_path(spark):
    n = 60
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101)], "a long, b long")
    out = got(components(edges))
    assert out == {i: (0,) for i in range(n)} | {100: (100,), 101: (100,)}


@pytest.mark.parametrize("op", ["lines", "bytes", "words", "near", "rewrite_lines", "rewrite_words", "one"])
def test_awkward_rows_have_defined_results(spark, table, awkward, op):
    run = {
        "lines": lambda d: dropped(d, indexed(d)),
        "bytes": without_bytes,
        "words": without_words,
        "near": near_duplicates,
        "rewrite_lines": lambda d: lines_removed(d, indexed(d)),
        "rewrite_words": repeats_removed,
        "one": one_of_each,
    }[op]
    out = run(awkward).collect()
    rows = {(r["doc_id"], i): r for i, r in enumerate(out)}
    ids = sorted(k[0] or 0 for k in rows)
    if op == "near":
        assert ids == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
        by = {r["doc_id"]: r for r in out if r["doc_id"]}
        assert (by[1]["class_id"], by[2]["class_id"], by[4]["class_id"], by[7]["class_id"]) == (1, 1, 3, 6)
        assert by[5]["n_links"] == 0 and by[4]["n_links"] == 1
    elif op == "one":
        assert ids == [0, 0, 1, 3, 5, 6, 8]
    else:
        assert ids == [0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8]
        if op in ("bytes", "words"):
            removed = {r["doc_id"]: r["n_removed"] for r in out if r["doc_id"]}
            assert removed[3] == 0 and removed[1] == removed[2] == removed[8] == 0
            assert removed[4] == (30_000 if op == "words" else len(" ".join(f"w{i}" for i in range(30_000))))
    if op.startswith("rewrite") or op == "one":
        assert sorted(out[0].asDict()) == sorted(awkward.columns)
    empty = run(awkward.limit(0)).collect()
    assert empty == []
