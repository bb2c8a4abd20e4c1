"""The near-dedup stage on one large group: what it links grows with the group, not with its pairs or its segments."""

import random

from test_near_copies import parts

from lamina.llm import near_copies


def test_a_group_gives_few_edges_and_the_same_components(spark, monkeypatch):
    rnd, seen, found = random.Random(8), [], near_copies.components
    base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rnd.sample(range(len(words)), rnd.randrange(1, 5)):
            words[at] = f"x{rnd.randrange(5000)}"
        rows.append((i, " ".join(words)))

    def counted(work, edges, *more):
        seen.append(edges.count())
        return found(work, edges, *more)

    monkeypatch.setattr(near_copies, "components", counted)
    groups = {}
    for (i, _), g in zip(rows, parts(rows)):
        groups[g] = min(i, groups.get(g, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r["doc_id"], r["component_id"]) for r in near_copies.near_copies(docs, hot=16).collect()) == sorted((i, groups[g]) for (i, _), g in zip(rows, parts(rows)))
    assert max(seen) <= 8 * len(rows), seen
