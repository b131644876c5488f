"""Containers: capacity, cover, little space unused, balance, and odd input."""

import numpy as np

from tessella.llm.packing import PackRule, pack, pack_documents, utilisation
from tessella.functions.tokens import encoding

DOCS = "doc_id long, text string, lane string, container string, n_tokens string"
LIM = "lane string, max_tokens int, overlap_tokens int, capacity_tokens int"


def test_pack():
    r = np.random.default_rng(0)
    sizes = np.minimum(r.lognormal(5, 1, 4000).astype(int), 1024)
    box = pack(sizes, 1024)
    assert ((box >= 0) == (sizes > 0)).all()
    used = np.bincount(box[box >= 0], weights=sizes[box >= 0])
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.97
    cost = np.bincount(box[box >= 0], weights=(sizes[box >= 0] ** 2).astype(float))
    order = np.argsort(-sizes, kind="stable")  # first fit by size alone, as a measure of balance
    assert cost.std() <= first_fit_spread(sizes[order], 1024) * 1.05


def test_lowest_cost():
    """Each item, in descending order, is in the container that had the lowest cost of those with room."""
    sizes = np.random.default_rng(3).integers(1, 300, 400)
    rule = PackRule()
    box = pack(sizes, 1000, rule)
    k = int(np.ceil(sizes.sum() / 1000))
    room, cost = np.full(k, 1000), np.zeros(k)
    slot: dict = {}
    for i in np.argsort(-sizes, kind="stable"):
        n = sizes[i]
        free = np.flatnonzero(room >= n)
        if not len(free):
            continue
        least = cost[free].min()
        j = slot.get(box[i])
        if j is None:
            j = slot[box[i]] = next(x for x in free if cost[x] == least and x not in slot.values())
        assert cost[j] == least
        room[j] -= n
        cost[j] += rule.linear * n + rule.quadratic * n * n


def first_fit_spread(sizes, capacity):
    room, cost = [], []
    for n in sizes[sizes > 0]:
        for i, x in enumerate(room):
            if x >= n:
                room[i] -= n
                cost[i] += float(n) ** 2
                break
        else:
            room.append(capacity - n)
            cost.append(float(n) ** 2)
    return np.std(cost)


def test_ties_and_trivial():
    assert pack(np.array([], np.int64), 10).tolist() == []
    assert pack(np.array([0, 0]), 10).tolist() == [-1, -1]
    assert len(set(pack(np.full(9, 5), 10).tolist())) == 5
    assert sorted(pack(np.array([10, 10]), 10).tolist()) == [0, 1]


def test_documents(spark):
    texts = [None, "", "word " * 7, "many words " * 2000] + [f"text number {i} " * (i % 40 + 1) for i in range(300)]
    rows = [(i, t, ["code", "CODE ", None, "prose"][i % 4], "x", "y") for i, t in enumerate(texts)]
    rows += rows[2:6] + [(None, "no id", "code", "", "")]
    lim = spark.createDataFrame([("code", 1, 1, 256), ("prose", 1, 1, 512), (None, 1, 1, 1)], LIM)
    got = pack_documents(spark.createDataFrame(rows, DOCS), lim, rule=PackRule(group_tokens=8000)).toPandas()
    sizes = {i: len(encoding().encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
    assert set(got["capacity"]) == {256, 512, 2048}
    boxes = got[got["container"].notna()].groupby("container")
    assert (boxes["n_tokens"].sum() <= boxes["capacity"].max()).all()
    assert set(got[got["container"].isna()]["doc_id"]) == {0, 1}
    cut = got[got["piece"] > 0]["doc_id"].unique()
    assert all(sizes[i] > got[got["doc_id"] == i]["capacity"].iloc[0] for i in cut)  # nothing else is split
    for _, b in boxes:
        b = b.sort_values("container_offset")
        assert (b["container_offset"].to_numpy() == b["n_tokens"].cumsum().to_numpy() - b["n_tokens"].to_numpy()).all()


def test_empty(spark):
    p = pack_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LIM))
    assert p.count() == 0 and utilisation(p).count() == 0
