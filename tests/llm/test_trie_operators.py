"""The prefix trie against brute force, and subtree sums over many shards, spilled queues and several levels."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from turnloom.llm.prefix_trie import prefix_trie, rebuilt
from turnloom.llm.time_forward import SpillingQueue, subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string, depth long, v string"


def brute(rows):
    """Nodes as {(conv_id, depth): the other columns}; no rows may tie in (conv_id, turn) with other texts."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    nodes, kids = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out, leaves, saved = {}, {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in kids[k])
        ends = ",".join(str(c) for c in nodes[k] if len(built[c]) == len(k))
        out[nodes[k][0], len(k)] = (nodes[k[:-1]][0] if k else None, len(nodes[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes_of(spark, rows, shards=None):
    got = prefix_trie(*rebuilt(spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)), shards).collect()
    out = {(r[0], r[1]): tuple(r[2:]) for r in got}
    assert len(out) == len(got)
    return out


def test_trie_equals_brute_force_whatever_the_shards(spark):
    rng = random.Random(3)
    rows = []
    for c in range(0, 420):
        if c == 200:  # a hundred without its first conversation
            continue
        for t in range(rng.choice([0, 1, 2, 3, 7])):
            rows.append((c, t if rng.random() < 0.9 or t else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * 3]) if t < 5 else "end"))
    rows += [(300, t, "user", "same") for t in range(8, 8 + 2500)]  # one conversation of many blocks
    rows += [(c, 0, "user", "hot first turn") for c in range(10_001, 10_400)]
    rows += [(500, 3, "user", "again")] * 7 + [(None, 1, "user", "nobody's")]
    want = brute([r for r in rows if r[0] is not None])
    assert nodes_of(spark, rows, 7) == want
    assert nodes_of(spark, rows[:300], 1) == brute(rows[:300])


def test_conversations_without_turns_and_empty_tables(spark):
    assert nodes_of(spark, []) == {}
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = nodes_of(spark, [(alone, 0, "user", "dropped, and its hundred has no first conversation")])
    assert got == {(alone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}


def test_subtree_sums_over_several_levels_of_shards(spark):
    """A caterpillar: each chain hangs on the end of the one before, so every shard has roots that hang on another."""
    rows, sums = [], {}
    for c in range(300):
        for d in range(c, c + 2):
            up = (c, d - 1) if d > c else (c - 1, d - 1) if c else (None, None)
            rows.append((c, d + 1, 0, up[0], None if up[0] is None else up[1] + 1, None if up[0] is None else 0, 1, d))
    parent = {(r[0], r[1]): (r[3], r[4]) for r in rows}
    for r in rows:
        at = (r[0], r[1])
        while at[0] is not None:
            v, w = sums.get(at, (0, 0))
            sums[at] = (v + r[6], w + r[7])
            at = parent[at]
    forest = spark.createDataFrame(rows, "c long, d long, p long, uc long, ud long, up long, v long, w long")
    for shards, most in ((1, 5), (12, 5)):
        assert {(r.c, r.d): (r.v, r.w) for r in subtree_sums(forest, shards, most).collect()} == sums


def test_spilling_queue_gives_what_a_heap_gives():
    rng, queue, kept = random.Random(1), SpillingQueue(10), []
    for _ in range(3000):
        if kept and rng.random() < 0.4:
            kept.sort()
            assert queue.peek() == kept[0] and queue.pop() == kept.pop(0)
        else:
            item = (rng.randint(0, 99), rng.random())
            kept.append(item)
            queue.push(item)
    assert [queue.pop() for _ in range(len(kept))] == sorted(kept) and queue.peek() is None
