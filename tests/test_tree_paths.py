import random

import pyarrow as pa

from lexiloom.operators import tree as TR


def test_batches_go_down_as_single_words_do():
    """Nodes without a child, unknown letters, letters that no node asks for and empty words; ``top`` cuts lists only."""
    dist = lambda k: [(f"p{k}{i}", 1 / (i + 1)) for i in range(3)]
    nodes = [(1, 3, "a", dist(1)), (2, 2, "b", dist(2)), (3, 4, TR.PAD, dist(3)), (4, None, None, dist(4)), (5, None, None, dist(5)), (6, None, None, dist(6))]
    walker = TR.Walker(nodes)
    r = random.Random(1)
    words = [[r.choice("abcz") for _ in range(r.randint(0, 6))] for _ in range(50)]
    for top in (None, 1):
        got = TR.Paths(walker, top).distributions(pa.array(words, pa.list_(pa.string()))).to_pylist()
        assert [[[(d["phone"], d["prob"]) for d in x] for x in w] for w in got] == [[x[:top] for x in walker.distributions(w)] for w in words]
