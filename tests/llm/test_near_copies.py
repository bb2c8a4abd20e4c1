"""The near-dedup stage against all pairs, by brute force."""

import random

from lamina.llm import near_copies


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def parts(rows, least=0.8):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not all_ or both >= least * all_:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def make():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows = []

    def edited(words, n):
        words = list(words)
        for at in rnd.sample(range(len(words)), n):
            words[at] = word()
        return " ".join(words)

    for size in (20, 60, 200, 600):
        for _ in range(8):
            base = [word() for _ in range(size)]
            rows += [" ".join(base)] + [edited(base, k) for k in (1, 1, max(1, size // 60), max(2, size // 45), max(3, size // 30))]
    base = [word() for _ in range(250)]
    rows += [edited(base, rnd.randrange(1, 7)) for _ in range(90)]  # a crowd, some of it beyond the limit
    chain = [word() for _ in range(200)]
    for _ in range(50):  # each near to the last, far from the first
        chain = chain[3:] + [word() for _ in range(3)]
        rows.append(" ".join(chain))
    rows = list(enumerate(rows)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (9005, "three"), (5, "another text of one id")]
    rnd.shuffle(rows)
    return rows


def test_stage_keeps_one_of_each_group(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for (i, _), g in zip(rows, parts(rows)):
        groups[g] = min(i, groups.get(g, i))
    want = sorted((i, t or "") for (i, t), g in zip(rows, parts(rows)) if i == groups[g])
    assert len(want) < len(rows) - 150
    assert sorted((r["doc_id"], r["text"] or "") for r in near_copies.keep_one(docs).collect()) == want
    least = sorted((i, groups[g]) for (i, _), g in zip(rows, parts(rows)))
    for hot, block in ((4, 16),):
        assert sorted((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(docs, hot=hot, block=block).collect()) == least
    assert near_copies.keep_one(docs.limit(0)).count() == 0
