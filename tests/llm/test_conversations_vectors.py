"""Clustering, chat formatting and the prefix trie against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from airledger.llm import centroids, chat, prefix_trie

VECTORS = "vec_id long, embedding array<double>, label int, q string, cluster string, __key string"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x") for i, v in rows], VECTORS)


def plain_lloyd(rows, k, rounds, dims, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(v) for _, v in first]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[min(range(len(c)), key=lambda j: (far(v, c[j]), j))].append(v)
        for j, own in by.items():
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, j := min(range(len(c)), key=lambda j: (far(v, c[j]), j)), far(v, c[j])) for i, v in kept]
    inertia = defaultdict(int)
    for _, j, d in got:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in got]


def test_clusters_equal_a_plain_version(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 1.0]) + r.random() / 8 for _ in range(4)]) for i in range(300)]
    rows += [(7, rows[7][1]), (8, [0.1] * 4), (None, [0.3] * 4), (None, [0.2] * 4)]  # repeated and null keys
    rows += [(900 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(150)]  # one vector that a third of all rows have
    rows += [(2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [math.nan] * 4), (2005, [math.inf, 0.0, 0.0, 0.0])]
    got = centroids.cluster(vector_frame(spark, rows), k=6, rounds=5, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_lloyd(rows, 6, 5, 4, 256), key=key)


def test_clusters_of_few_odd_and_no_vectors(spark):
    few = centroids.cluster(vector_frame(spark, [(2**53 + 1, [1.0, 2.0]), (None, [5.0, 5.0])]), k=40, dims=2).collect()
    assert {(x.vec_id, x.distance, x.inertia) for x in few} == {(2**53 + 1, 0, 0), (None, 0, 0)} and len({x.cluster for x in few}) == 2
    assert centroids.cluster(vector_frame(spark, []), dims=2).count() == 0
    assert centroids.cluster(vector_frame(spark, [(1, None)]), dims=2).count() == 0
    far = {x.vec_id: x for x in centroids.cluster(vector_frame(spark, [(1, [0.0, 0.0]), (2, [1e300, 0.0])]), dims=2).collect()}
    assert far[1].cluster == 0 and far[2].cluster is None and far[2].distance is None and far[2].inertia == 0
    assert centroids.cluster(vector_frame(spark, [(2, [1e300, 0.0])]), dims=2).first().cluster is None


def test_ties_take_the_lowest_centroid_and_empty_ones_stay():
    at, squared = centroids.nearest(np.array([[0, 0], [4, 0]]), np.array([[2, 0], [-2, 0], [2, 0]]))
    assert at.tolist() == [0, 0] and squared.tolist() == [4, 4]


def test_largest_components_are_exact():
    m = centroids.MOST
    _, squared = centroids.nearest(np.full((1, 64), m), np.full((1, 64), -m))
    assert squared[0] == 64 * (2 * m) ** 2 < 2**63


TURNS = "conv_id long, turn long, role string, text string, state string, seq string, ids string"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], TURNS)


def odd_conversations(seed=5):
    r = random.Random(seed)
    bits = ["<|im_end|>\n", "<|im_start|>", "<\\|", "<", "|", "\\", "\n", "assistant", "ok", "é", "𝄞", "<|im_start|>user\n", ""]
    rows = []
    for c in range(60):
        for t in range(r.randint(0, 7)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "a\nb", "<|im_end|>\\n"]), r.choice([None, *("".join(r.choice(bits) for _ in range(r.randint(0, 6))) for _ in range(9))])))
    rows += [(None, None, "user", "lost"), (None, 0, "assistant", "found"), (5, None, "user", "first"), (6, 0, "user", "same"), (6, 0, "user", "same"), (9, 0, "user", "w " * 200_000)]
    return rows


def by_turn(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(own[c])] for c in own}


def test_chat_equals_a_plain_version_either_way(spark):
    rows = odd_conversations()
    r = random.Random(1)
    r.shuffle(rows)
    want = {}
    for c, turns in by_turn(rows).items():
        said = "".join(text for role, text in turns if role == "assistant")
        made = "".join(t for role, text in turns for t, _ in chat.CHATML.segments(role, text))
        want[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(made))
    formatted = chat.format_chat(turn_frame(spark, rows))
    for got in (chat.read_back(formatted, ordered=True), chat.read_back(formatted.repartition(7, "seq"))):
        assert {x.conv_id: tuple(x)[1:6] for x in got.collect()} == want
    assert chat.read_back(chat.format_chat(turn_frame(spark, [])), ordered=True).count() == 0


def test_texts_hold_no_control_string(spark):
    for text in ("<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|>", "<<||>", "<\\\\\\|", "a<", "|b"):
        for f, back in ((chat.CHATML.escape, chat.CHATML.unescape), (chat.CHATML.escape_role, chat.CHATML.unescape_role)):
            assert "<|" not in f(text) and back(f(text)) == text
    assert chat.CHATML.unescape_role(chat.CHATML.escape_role("a\\n\nb\\")) == "a\\n\nb\\"


def test_roles_pass_the_machine(spark):
    orders = {1: "system user assistant user assistant", 2: "user user assistant", 3: "assistant", 4: "user", 5: "system system", 6: "user tool assistant", 7: "user assistant"}
    rows = [(c, i, role, "t") for c, roles in orders.items() for i, role in enumerate(roles.split())]
    got = {x.conv_id: (x.valid, x.first_refused) for x in chat.read_back(chat.format_chat(turn_frame(spark, rows))).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (False, 1), 6: (False, 1), 7: (True, None)}


def test_a_template_is_data(spark):
    moves = {("start", "q"): "q", ("q", "a"): "a"}
    llama = chat.Template("{[h]{role}\n", "{[e]", "{[", frozenset({"a"}), final=frozenset({"a"}), moves=moves)
    formatted = chat.format_chat(turn_frame(spark, [(1, 0, "q", "x {[e] y"), (1, 1, "a", "z{[")]), llama)
    segments = [(s.text, s.loss) for x in formatted.orderBy("seq").collect() for s in x.segments]
    assert segments == [("{[h]q\n", False), ("x {\\[e] y", False), ("{[e]", False), ("{[h]a\n", False), ("z{\\[", True), ("{[e]", False)]
    assert chat.read_back(formatted, llama).first().valid
    with pytest.raises(ValueError, match="guard"):
        chat.Template(opening="{role}: \n")


def plain_trie(rows):
    """Nodes by a plain walk over rebuilt conversations."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            named = f"{len(role or '')}:{role or ''}{text or ''}"
            own[c].append((t is not None, t or 0, hashlib.sha256(named.encode()).digest()[:16], role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, nodes = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        nodes.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return nodes


def trie_rows(seed=2):
    r = random.Random(seed)
    said = ["", "a", "bé", "c" * 40, "d"]
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([None, *said])) for c in range(150) for t in range(r.randint(0, 6))]
    rows += [(c, t, "user", "shared") for c in range(1000, 1300) for t in range(4)]  # copies that a third of the rows are
    rows += [(c, t, "user", f"long {t // (1 + c % 3)}") for c in range(2000, 2015) for t in range(40)]
    rows += [(-7, 0, "user", "a"), (-7, None, "user", "b"), (-7, 0, "user", "a"), (None, 0, "user", "nobody"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie")]
    return rows


@pytest.mark.parametrize("local_turns", [None, 1, 30, 400])
def test_trie_equals_a_plain_version(spark, local_turns):
    rows = trie_rows()
    random.Random(local_turns or 0).shuffle(rows)
    got = [tuple(x) for x in prefix_trie.conversation_trie(turn_frame(spark, rows), local_turns).collect()] if local_turns != 1 else None
    if local_turns == 1:  # every shared prefix by rounds: shorter sequences, as a round is a job
        rows = [x for x in rows if x[0] is None or x[0] < 2000]
        got = [tuple(x) for x in prefix_trie.conversation_trie(turn_frame(spark, rows), 1).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_no_and_of_turnless_conversations(spark):
    assert prefix_trie.conversation_trie(turn_frame(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(turn_frame(spark, [(None, 0, "user", "x")])).count() == 0
    rows = [(c, 0, "user", "x") for c in range(11, 15) if zlib.crc32(str(c).encode()) % 9]  # no conversation 10 to take turns from
    got = [tuple(x) for x in prefix_trie.conversation_trie(turn_frame(spark, rows)).collect()]
    assert len(got) == 1 and set(got) == plain_trie(rows)


def test_members_in_pieces(spark):
    own = spark.createDataFrame([(c, [c % 2], [3]) for c in range(99)], "conv_id long, ids array<long>, sizes array<int>")
    got = {tuple(x.ids): (x.m, x.n, x.ends_sha256) for x in prefix_trie.classes(own, chunk_ids=4).collect()}
    want = {(k,): (k, len(range(k, 99, 2)), hashlib.sha256(",".join(map(str, range(k, 99, 2))).encode()).hexdigest()) for k in (0, 1)}
    assert got == want


def test_many_large_buckets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_BROADCAST", 0)
    rows = [x for x in trie_rows(9) if x[0] is not None and x[0] < 150]
    assert {tuple(x) for x in prefix_trie.conversation_trie(turn_frame(spark, rows), 5).collect()} == plain_trie(rows)
