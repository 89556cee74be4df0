"""The near-copy stage against brute force over the fingerprints of the texts."""

import random

import corpus_pipeline as pipeline
from journalsieve.llm.simhash import fingerprint


def test_near_copies_against_brute_force(spark):
    draw = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [None, "", "  ", "one", "ONE", "two words"]
    for _ in range(8):
        base = draw.choices(words, k=draw.randint(20, 300))
        for edits in (0, 0, 1, 1, 2, 5):
            other = list(base)
            for _ in range(edits):
                other[draw.randrange(len(other))] = draw.choice(words)
            texts.append(" ".join(other))
    rows = [(draw.choice([None, k, k, k % 7]), t, "en", draw.choice("ab"), len(t or ""), "x") for k, t in enumerate(texts)]
    rows += rows[:9]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, name string")
    kept = pipeline.drop_near_copies(spark, table, "")
    assert kept.columns == table.columns
    prints = [fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    groups = {}
    for row, x in zip(rows, label):
        groups.setdefault(x, []).append(row)
    found = kept.collect()
    assert len(found) == len(groups)
    for members in groups.values():
        mine = [r for r in found if tuple(r) in members]
        assert len(mine) == 1
        ids = [m[0] for m in members if m[0] is not None]
        assert mine[0].doc_id == (min(ids) if ids else None)
