import random
import re

import numpy as np

from quantspan.llm import lsh_forest
from quantspan.llm.lsh_forest import Settings

from cases import frame, none, odd, odd_rows, prose, words


def brute(rows, similarity=0.8):
    """Class (smallest id) and number of links of every row."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set())
    links, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= similarity * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    ids = [i for i, _ in rows]
    return [(i, min(ids[k] for k in range(len(rows)) if group[k] == group[n]), links[n]) for n, i in enumerate(ids)]


def near_copies(n_groups=12, seed=1):
    rng, rows, i = random.Random(seed), [], 0
    for g in range(n_groups):
        base = prose(g, 120).split()
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def result(df):
    return sorted((r.doc_id, r.class_id, r.n_links) for r in df.select("doc_id", "class_id", "n_links").collect())


def test_equals_all_pairs(spark):
    rows = near_copies()
    want = sorted(brute(rows))
    assert sum(n for _, _, n in want) > 50
    assert result(lsh_forest.join(frame(spark, rows))) == want


def test_blocks_of_a_large_group_and_recall(spark):
    rng, base, rows = random.Random(7), prose(5, 150).split(), []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    want = sorted(brute(rows))
    got = result(lsh_forest.join(frame(spark, rows), s=Settings(block=16)))
    assert all(g[2] <= w[2] for g, w in zip(got, want))  # no link is counted twice
    assert sum(g[2] for g in got) >= 0.97 * sum(w[2] for w in want)
    assert got == result(lsh_forest.join(frame(spark, rows)))  # whatever the blocks


def test_expected_recall_sets_the_depth():
    s = Settings()
    depth = max(d for d in range(1, 13) if s.chance(0.8, d) >= s.recall)
    assert depth == 8 and s.chance(0.8, 8) >= 0.985 > s.chance(0.8, 9)
    rng = np.random.default_rng(2)
    hits = 0
    for _ in range(60):
        shared, own = rng.integers(0, 1 << 62, 160, dtype=np.uint64), rng.integers(0, 1 << 62, 40, dtype=np.uint64)
        a, b = np.sort(np.concatenate([shared, own[:20]])), np.sort(np.concatenate([shared, own[20:]]))
        doc = np.repeat([0, 1], [len(a), len(b)])
        p = lsh_forest.prefixes(doc, np.concatenate([a, b]), 2, depth, s)
        hits += (p[0] == p[1]).any()
    assert hits >= 54  # similarity 0.8


def test_one_document_of_each_group_stays(spark):
    rows = near_copies(6, 3) + [(900, prose(70)), (901, prose(70)), (901, prose(70)), (902, None), (903, "")]
    docs = frame(spark, rows)
    kept = lsh_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    want = sorted({c for i, c, n in brute(rows) if i not in (902, 903)} | {902, 903})
    assert sorted(r.doc_id for r in kept.collect()) == want
    again = frame(spark, [(1, prose(4)), (1, prose(4)), (2, prose(4)), (3, prose(5))])
    assert sorted(r.doc_id for r in lsh_forest.one_of_each(again).collect()) == [1, 3]


def test_odd_rows(spark):
    got = lsh_forest.join(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {(r.doc_id, r.sid is None): r for r in got}
    assert by[1, False].n_links == 1 and by[8, False].class_id == 1
    assert by[2, True].n_links == 0 and by[5, False].n_links == 0 and by[10, False].n_links == 1
    assert lsh_forest.join(none(spark)).count() == 0
    assert lsh_forest.one_of_each(none(spark)).count() == 0


def lone_pairs(n, kept=93):
    """Pairs whose only link is at 0.802: 89 of 111 shingles."""
    rng, rows = random.Random(11), []
    for i in range(n):
        w = words(rng, 104)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:kept], *(f"{x}q{i}" for x in words(rng, 104 - kept))]))]
    return rows


def test_no_pair_at_the_threshold_is_lost(spark):
    got = result(lsh_forest.join(frame(spark, lone_pairs(500))))
    assert got == [(i, i - i % 2, 1) for i in range(1_000)]


def test_late_links_shorten_the_prefixes(spark):
    """One of 500 links near the threshold is found last, none of the closer ones."""
    s = Settings()
    depth = lambda rows: lsh_forest.forest(lsh_forest._rows(frame(spark, rows), "doc_id", "text"), s)[0]
    assert s.start() == 5 and depth(lone_pairs(60, 103)) == 5 and depth(lone_pairs(500)) == 4
