"""The containment ensemble against all pairs, on the documents and on awkward rows."""

import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillframe.llm import near_dedup as nd
from quillframe.llm import textvec


def shingles(text, width=3):
    found = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


def brute(rows):
    """All pairs of row numbers (smaller set, larger set, size ratio) of which the first lies in the second, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    by, shared = collections.defaultdict(list), collections.Counter()
    for n, s in enumerate(sets):
        for x in s:
            by[x].append(n)
    for members in by.values():
        for i, b in enumerate(members):
            for a in members[:i]:
                shared[a, b] += 1
    out = []
    for (a, b), n in shared.items():
        a, b = (a, b) if len(sets[a]) <= len(sets[b]) else (b, a)
        if n >= 0.6 * len(sets[a]):
            out.append((a, b, len(sets[b]) / len(sets[a])))
    return out


@pytest.mark.parametrize("limit", [nd.common.BROADCAST_BYTES, 0])
def test_recall_and_precision_over_all_pairs_of_any_ratio(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(nd.common, "BROADCAST_BYTES", limit)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    pairs, ids = brute(rows), [d for d, _ in rows]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found, links = nd._grouped(docs, nd.Settings())
    group = {r.doc_id: r.group_id for r in found.collect()}
    linked = {(r.small_id, r.large_id) for r in links.collect()}
    hit = [group.get(ids[a], ids[a]) == group.get(ids[b], ids[b]) or (group.get(ids[a], ids[a]), group.get(ids[b], ids[b])) in linked for a, b, _ in pairs]
    far = [h for h, (_, _, ratio) in zip(hit, pairs) if ratio > nd.COPY_RATIO]
    print(f"{len(pairs)} pairs, recall {sum(hit) / len(hit):.3f}; {len(far)} beyond the copy ratio, recall {sum(far) / len(far):.3f}")
    assert len(far) > 10 and sum(hit) >= 0.9 * len(hit) and sum(far) >= 0.9 * len(far)
    # nothing that isn't there: groups are connected by true pairs, links join groups that have a true pair
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {d: n for n, d in enumerate(ids)}
    for a, b, ratio in pairs:
        if ratio <= nd.COPY_RATIO:
            root[find(a)] = find(b)
    assert all(find(at[d]) == find(at[g]) for d, g in group.items())
    true = {(group.get(ids[a], ids[a]), group.get(ids[b], ids[b])) for a, b, _ in pairs}
    assert linked <= true
    if limit:
        assert {r.doc_id: r.links for r in nd.opquery(spark, sf).collect() if r.links} == {d: sum(1 for x, _ in linked if x == g) for d, g in group.items() if any(x == g for x, _ in linked)}


def test_nothing_depends_on_what_fits_a_broadcast(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)).split()
    rows = []
    for i in range(6):  # families of texts that grow by degrees, of which only some members lie in only some members of others
        parts = [text(60) for _ in range(8)]
        for j in range(8):
            rows += [sum(parts[: j + 1], []), parts[j], parts[j][: 15 + 5 * j] + text(30), text(200) + parts[j] + sum(parts[: j // 2], [])]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(rows)], "doc_id long, text string")

    def result():
        found, links = nd._grouped(docs, nd.Settings())
        kept = sorted(r.doc_id for r in nd.drop_near_copies(docs).collect())
        return sorted(map(tuple, found.drop("h").collect())), sorted(map(tuple, links.collect())), kept

    want = result()
    monkeypatch.setattr(nd.common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(nd, "BLOCK_BYTES", 1 << 14, raising=False)
    monkeypatch.setattr(nd, "GATHERED", 1 << 10, raising=False)
    assert len(want[1]) > 50 and result() == want


def awkward(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    edit = list(base)
    edit[100] = "changed"
    long = [word() for _ in range(60_000)]
    rows = [
        (1, " ".join(base)), (2, " ".join(edit)), (2, " ".join(edit)), (3, None), (4, None), (5, ""), (6, " \n!!"), (None, " ".join(base).upper()),
        (7, "one"), (8, "One!"), (9, "two words"), (10, " ".join(long)), (11, " ".join(long[:-9])), (12, " ".join(base[:40])), (13, " ".join(word() for _ in range(300))),
    ]
    df = spark.createDataFrame([(d, t, "k", 1, 2, 3) for d, t in rows], "doc_id long, text string, key string, nid int, h int, label int")
    return rows, df


def test_awkward_rows(spark):
    rows, df = awkward(spark)
    want = {(1, 1), (2, 1), (None, 1), (7, 7), (8, 7), (10, 10), (11, 10)}
    assert {(r.doc_id, r.group_id) for r in nd.near_groups(df).collect()} == want
    out = nd.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 13]  # 12 lies in 1


def test_short_in_long(spark):
    rows, df = awkward(spark)
    assert sorted(map(tuple, nd.group_links(df).collect())) == [(12, 1)]
    got = {(r.doc_id, r.group_id, r.copies, r.links) for r in nd.near_copies(df).collect()}
    assert (12, 12, 1, 1) in got and (1, 1, 4, 0) in got and len(got) == 7 + 1


def test_a_passage_in_many_texts_links_and_joins_nothing(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = text(20)
    rows = [(i, text(rng.randint(100, 300)) + " " + passage + " " + text(50)) for i in range(300)] + [(1000 + i, passage + " " + text(i % 4)) for i in range(40)]
    found, links = nd._grouped(spark.createDataFrame(rows, "doc_id long, text string"), nd.Settings())
    assert {(r.group_id, r.copies, r.links) for r in found.collect()} == {(1000, 40, 300)}
    assert {(r.small_id, r.large_id) for r in links.collect()} == {(1000, i) for i in range(300)}


def test_a_long_text_takes_bounded_room(spark):
    data = np.frombuffer(b"some words that are the same in every line of this text 0123456\n" * 400_000 + b"x" * 5_000_000, np.uint8)
    tracemalloc.start()
    sets, at = textvec.shingle_sets(data, np.array([0, len(data)]), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at.tolist() == [0, len(sets)] and len(sets) == 14 and peak < 12 * len(data)


def test_texts_are_held_against_sets_in_bounded_room():
    rng = np.random.default_rng(6)
    names, shared = [f"w{i}" for i in range(50_000)], " ".join(x + y for x in "abcd" for y in "abcd")
    keys = next(nd._sets(pa.array([shared]), 3))[2]
    n, k = 3000, len(keys)  # sets that are all asked for by the same keys: each text meets all of them
    block = (keys, np.arange(k + 1) * n, np.tile(np.arange(n), k), np.arange(n, dtype=np.uint64), np.arange(n), np.full(n, k), np.full(n, k), np.ones(n, np.int64), np.arange(n + 1) * k, np.tile(keys, n))
    texts = [" ".join(names[i] for i in rng.integers(0, len(names), 5000)) + " " + shared for _ in range(300)]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "h": [0] * 300, "text": texts})
    tracemalloc.start()
    found = sum(out.num_rows for out in nd._container(nd.Settings(), [type("Block", (), {"value": block})()], type("Known", (), {"value": np.full(1 << 10, ~np.uint64(0))})())([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(f"{found} rows, at most {peak / 1e6:.0f} MB")
    assert found and peak < 80e6


def test_two_classes_give_an_edge_of_a_kind_however_many_of_their_sets_lie_in_others(spark, monkeypatch):
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, more = text(24), text(200)
    rows = [passage + text(i // 2) for i in range(12)] + [more[: 200 - i] + passage for i in range(20)]  # two families, each of the first lies in each of the second
    found, edges = [], nd._class_edges

    def kept(*args):
        out = edges(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(nd, "_class_edges", kept)
    groups, links = nd._grouped(spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(rows)], "doc_id long, text string"), nd.Settings())
    assert {(r.group_id, r.copies, r.links) for r in groups.collect()} == {(0, 12, 1), (12, 20, 0)}
    assert [(r.small_id, r.large_id) for r in links.collect()] == [(0, 12)]
    assert 1 <= found[0] <= 2


def test_links_to_single_texts_are_counted_where_they_stand(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    small, large, other = text(20), text(90), text(25)
    rows = [text(rng.randint(100, 300)) + " " + small + " " + text(50) for _ in range(60)] + [text(250) + " " + large + " " + small for _ in range(60)]
    rows += [small, small + " " + text(2), large, large + " " + text(4)]  # 120 and 121: links to 120 texts each; 122 and 123: to 60
    rows += [other, other + " " + text(1), *[text(200) + " " + other] * 2, text(300) + " " + other]  # 126 and 127 are rows of one text
    docs, found, edges = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), [], nd._class_edges

    def kept(*args):
        out = edges(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(nd, "_class_edges", kept)
    got = {(r.doc_id, r.group_id, r.copies, r.links) for r in nd.near_copies(docs).collect()}
    listed = {(r.group_id, r.inside) for r in nd.group_links(docs).collect()}
    assert {(i, 120) for i in range(120)} <= {(b, a) for a, b in listed} and {(122, i) for i in range(60, 120)} <= listed
    assert {(124, 126), (124, 128)} <= listed
    counts = {g: sum(a == g for a, _ in listed) for _, g, _, _ in got}
    assert {(120, 120, 2, 120), (121, 120, 2, 120), (122, 122, 2, 60), (123, 122, 2, 60), (124, 124, 2, 2), (126, 126, 2, 0)} <= got
    assert all(links == counts[g] for _, g, _, links in got)
    assert {r.doc_id for r in nd.drop_near_copies(docs).collect()} == {*range(120), 126, 128}
    assert found[0] < 80  # and not the 120 links of the small texts, too


def test_distinct_is_unique_by_text():
    rng = np.random.default_rng(4)
    found, at = rng.integers(0, 9, 400).astype(np.uint64), np.r_[0, 0, np.sort(rng.integers(0, 401, 30)), 400, 400]
    sets, places = textvec.distinct(found, at)
    assert [sets[a:b].tolist() for a, b in zip(places[:-1], places[1:])] == [np.unique(found[a:b]).tolist() for a, b in zip(at[:-1], at[1:])]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert nd.near_groups(df).count() == 0
    assert nd.drop_near_copies(df).count() == 0


def test_components_of_chains_and_ties(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 201)]
    got = {r.v: r.label for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200}


def test_every_pair_of_partitions_keeps_its_recall_with_its_own_banding():
    setting, seen = nd.Settings(), {}
    filled = [p for p in range(60) if nd.partition_bounds(p)[0] <= nd.partition_bounds(p)[1]]
    for p in filled:
        for q in setting.probes(p):
            bands, rows = seen[p, q] = setting.bands(p, q)
            low, high = nd.partition_bounds(p)[0], nd.partition_bounds(q)[1]
            s = nd.jaccard_threshold(nd.CONTAINMENT, min(high, int(low * nd.COPY_RATIO)), low)
            assert bands * rows <= nd.HASHES and 1 - (1 - s**rows) ** bands >= 0.9 - 1e-9
            for size, other in ((low, nd.partition_bounds(q)[0]), (nd.partition_bounds(p)[1], high)):  # both sides have these bands
                tag = p + 1 if p == q and rows > 2 else 0
                assert all(any(t == tag and r == rows and b >= bands for t, b, r in setting.schemes(n)) for n in (size, other))
    assert len(set(seen.values())) > 5 and len({bands for (p, q), (bands, _) in seen.items() if p > 20}) >= 4


def test_least_shared_keeps_its_recall():
    for k in range(1, 65):
        m = nd.least_shared(k, 0.6)
        assert m == 1 or sum(math.comb(k, i) * 0.6**i * 0.4 ** (k - i) for i in range(m, k + 1)) >= 0.97


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_words_in_blocks_hash_alike(block):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["a" * 50]
    raw, at = textvec.buffers(pa.array(texts))
    want, got = textvec.words(raw, at), textvec.words(raw, at, block=block)
    assert want[0].tolist() == got[0].tolist() and want[1].tolist() == got[1].tolist()


def test_words_hash_alike_wherever_they_stand():
    raw, at = textvec.buffers(pa.array(["a bc  é a", None, "", "bc", "a bc"]))
    found, offsets = textvec.words(raw, at)
    assert offsets.tolist() == [0, 4, 4, 4, 5, 7]
    assert found[0] == found[3] == found[5] and found[1] == found[4] == found[6] and len(set(found.tolist())) == 3
    runs, at2 = textvec.shingles(found, offsets, 3)
    assert at2.tolist() == [0, 2, 2, 2, 3, 4]
