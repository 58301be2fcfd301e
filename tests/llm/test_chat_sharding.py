"""Transcript parsing and sharding against brute force and the truth."""

import collections
import itertools
import math
import random
import struct

import numpy as np
import pytest
import xxhash

from quillframe.llm import chat_transcripts as ct
from quillframe.llm import label_sharding as ls


@pytest.fixture(scope="module")
def conversations(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet")


def test_roles_of_unseen_conversations(spark, conversations):
    model = ct.train(conversations.filter("conv_id % 2 = 0"))
    held = conversations.filter("conv_id % 2 = 1")
    got = {r.conv_id: r for r in ct.parse(ct.write_out(held), model).collect()}
    right = exact = total = 0
    for c in ct.conversations_of(held).collect():
        turns = [(t.role, t.text) for t in c.turns]
        want = [r for r, _ in ct.transcript_of(turns, 0)[1]]
        found = got[c.conv_id].roles.split(",")
        total += len(want)
        right += sum(a == b for a, b in zip(want, found)) if len(want) == len(found) else 0
        exact += got[c.conv_id].rendered == ct.render([(r, t.strip()) for r, t in turns])
    assert right / total >= 0.9 and exact / len(got) >= 0.8


@pytest.mark.parametrize("unseen", [0, 1, 2, 3, 4])
def test_roles_in_styles_never_trained_on(spark, conversations, unseen):
    """Markers of a form that training lacks are read as well; styles without markers (5, 6) have to be trained on."""
    model = ct.train(conversations.filter("conv_id % 2 = 0"), styles=tuple(k for k in range(ct.STYLES) if k != unseen))
    right = total = 0
    for c in ct.conversations_of(conversations.filter("conv_id % 2 = 1")).collect():
        text, truth = ct.transcript_of([(t.role, t.text) for t in c.turns], unseen)
        found = model.turns(text)
        total += len(truth)
        right += sum(a[0] == b[0] for a, b in zip(truth, found)) if len(truth) == len(found) else 0
    assert right / total >= 0.9


def test_transcripts_written_by_hand(spark, conversations):
    model = ct.train(conversations)
    cases = {
        "> Customer: It broke.\n> Support - Which one?\n> Customer: The blue one.\nIt is old.": ["user", "assistant", "user"],
        "- **Agent:** Hello, how can I help?\n- **Client:** Where is my order?\n\n- **Agent:** On its way.": ["assistant", "user", "assistant"],
        "(system) Be brief.\n(human) Why is the sky blue?\n(ai) Scattering.": ["system", "user", "assistant"],
        "Setup: You are a bot.\n\nQuestion: One?\n\nAnswer: Two.\n\nAnd three.": ["system", "user", "assistant"],
    }
    for text, roles in cases.items():
        assert [r for r, _ in model.turns(text)] == roles, text


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(20):
        model = ct.Model(rng.normal(size=6), rng.normal(size=(6, 6)), [rng.normal(size=(6, *n)) for n in ct.SIZES])
        seen = [tuple(int(rng.integers(n[0])) for n in ct.SIZES) for _ in range(4)]

        def score(path):
            s = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return s + sum(model.emit[k][p, f[k]] for p, f in zip(path, seen) for k in range(4))

        assert score(model.path(seen)) == pytest.approx(max(map(score, itertools.product(range(6), repeat=4))))


def test_transcripts_awkward(spark, conversations):
    model = ct.train(conversations)
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "User: hi <|end|>\n\nAssistant: yes?\nmore"), (4, "Q: " + "x" * 300_000 + "\nA: " + "y\n" * 20_000), (4, "no marker at all")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, transcript string, roles int, n_turns string")
    got = sorted(((r.conv_id, r.n_turns, r.roles, r.rendered) for r in ct.parse(df, model).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, 0, "", "") for i in (1, 2, 3)]
    assert (None, 2, "user,assistant", "<|user|>\nhi < |end|>\n<|end|>\n<|assistant|>\nyes?\nmore\n<|end|>\n") in got
    assert sorted(g[2] for g in got if g[0] == 4)[-1] == "user,assistant" and sum(g[0] == 4 for g in got) == 2
    bare = spark.createDataFrame([(1, None, None, None), (1, 0, "odd", None), (None, 0, "user", "a"), (1, 0, "odd", None)], "conv_id long, turn long, role string, text string")
    assert ct.parse(ct.write_out(bare), ct.train(bare)).count() == 2
    none = bare.limit(0)
    assert ct.parse(ct.write_out(none), ct.train(none)).count() == 0


def slice_of(rid, k):
    """Spark's xxhash64 of a bigint and an int."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", k), seed=xxhash.xxh64_intdigest(struct.pack("<q", rid), seed=42))
    return (h - (h >> 63 << 64)) % ls.SLICES


def brute(count, edges, shards, slack):
    """The shard of each row number after 0, 1, 2, ... rounds by the same rules, in plain Python."""
    by = collections.defaultdict(list)
    for rid, hub in edges:
        by[hub].append(rid)
    label = {rid: rid * shards // count for rid in range(count)}
    capacity = math.ceil(count / shards * (1 + slack))
    for k in itertools.count():
        yield dict(label), by, capacity
        pull = collections.defaultdict(collections.Counter)
        for members in by.values():
            at = collections.Counter(label[m] for m in members)
            w = max(1, ls.UNIT // (len(members) - 1))
            for m in members:
                for s, c in at.items():
                    pull[m][s] += (c - (s == label[m])) * w
        asked = collections.defaultdict(lambda: collections.defaultdict(list))
        for m, c in pull.items():
            n, s = max((n, -s) for s, n in c.items())
            gain = n - c.get(label[m], 0)
            if -s != label[m] and gain > 0 and ls.turn_of(m, k) == 0:
                asked[label[m], -s][-(gain.bit_length() - 1), slice_of(m, k)].append(m)
        sizes = [sum(1 for x in label.values() if x == s) for s in range(shards)]
        groups = {p: [(-level, s, len(m)) for (level, s), m in sorted(v.items())] for p, v in asked.items()}
        for (a, b), taken in ls.grants(groups, sizes, capacity).items():
            for level, s, _ in taken:
                for m in asked[a, b][-level, s]:
                    label[m] = b


def cut(label, by):
    """Weight of the pairs whose documents lie in different shards."""
    lost = whole = 0.0
    for members in by.values():
        n = len(members)
        same = sum(c * (c - 1) / 2 for c in collections.Counter(label[m] for m in members).values())
        lost += (n * (n - 1) / 2 - same) / (n - 1)
        whole += n / 2
    return lost / whole


def parts_of(docs):
    rows, edges = ls.linked(docs)
    return {r.rid: r.doc_id for r in rows.collect()}, [(e.rid, e.hub) for e in edges.collect()]


def test_sharding_equals_brute_force_until_the_cut_no_longer_falls(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, edges = parts_of(docs)
    assert sorted(ids) == list(range(len(ids)))
    got, cuts, states = {r.doc_id: r.shard for r in ls.opquery(spark, sf).collect()}, [], []
    for label, by, capacity in brute(len(ids), edges, ls.SHARDS, ls.SLACK):
        states.append({ids[i]: s for i, s in label.items()})
        cuts.append(cut(label, by))
        assert max(collections.Counter(label.values()).values()) <= capacity
        if len(cuts) > 40:
            break
    best = states.index(got)
    print(f"cut {cuts[0]:.3f} as dealt out, {cuts[best]:.3f} after {best} rounds, {min(cuts):.3f} the least of 40")
    assert cuts[best] == min(cuts[: best + 1]) and cuts[best] - min(cuts[: best + ls.QUIET + 1]) <= 2 * ls.PROGRESS and cuts[best] < cut({i: i % ls.SHARDS for i in ids}, by) * 0.4
    assert {r.doc_id: r.shard for r in ls.shard(docs, rounds=2).collect()} == states[2]
    assert all(len({ls.turn_of(i, k + j) for j in range(ls.QUIET)}) == 2 for i in range(300) for k in range(60))


def test_the_layout_of_the_table_makes_no_difference(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.filter("doc_id % 3 = 0")
    one = sorted(map(tuple, ls.shard(docs.coalesce(1)).collect()))
    assert one == sorted(map(tuple, ls.shard(docs.repartition(7, "text")).collect()))


def test_grants_never_exceed_the_capacity():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randint(5, 10) for _ in range(4)]
        groups = {(a, b): [(-i, 0, rng.randint(1, 3)) for i in range(rng.randint(1, 3))] for a in range(4) for b in range(4) if a != b and rng.random() < 0.6}
        after = list(sizes)
        for (a, b), x in ls.grants(groups, sizes, 10).items():
            assert x == groups[a, b][: len(x)]
            after[a] -= sum(g[2] for g in x)
            after[b] += sum(g[2] for g in x)
        assert max(after) <= 10


def test_sharding_awkward(spark):
    line = "one line that is long enough to count\n"
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line + "x"), (4, line * 5000 + "another line of sufficient length"), (5, "another line of sufficient length")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, shard int, rid int")
    out = ls.shard(df, shards=2, slack=0.2)
    assert out.columns == ["doc_id", "shard"] and out.count() == 7
    assert max(c["count"] for c in out.groupBy("shard").count().collect()) <= math.ceil(7 / 2 * 1.2)
    assert ls.shard(df.limit(0)).count() == 0
