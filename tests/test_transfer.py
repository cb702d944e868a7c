"""Import of linked tables: order, clashes, cycles, what became of every row."""

import random

import pytest

from memlattice.sources import transfer
from memlattice.sources.transfer import Table

BANK = [Table("facts", "fact", {"doc": "docs"}), Table("docs", "doc"), Table("pages", "page", {"doc": "docs"}, parent="parent")]
SCHEMAS = {"docs": "doc string, title string", "facts": "fact long, doc string, text string", "pages": "page string, parent string, doc string"}


def bank(spark, docs, facts, pages):
    rows = {"docs": docs, "facts": facts, "pages": pages}
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def held(tables, name):
    return sorted(map(tuple, tables[name].collect()), key=repr)


def outcomes(report):
    return {(r.table, r.old): r.outcome for r in report.collect()}


STORE = ([("a", "old a"), ("b", "old b")], [(1, "a", "x"), (2, "b", "y")], [("p", None, "a"), ("q", "p", "b")])
SENT = ([("b", "new b"), ("c", "new c")], [(2, "b", "Y"), (3, "c", "z"), (4, "b", "w"), (5, "gone", "v"), (6, None, None)], [("q", None, "b"), ("r", "q", "c"), ("s", "lost", "c"), ("t", "s", None), ("u", "v", None), ("v", "u", None)])


def test_skip(spark):
    out, report = transfer.imported(bank(spark, *STORE), bank(spark, *SENT), BANK, "skip")
    assert held(out, "docs") == [("a", "old a"), ("b", "old b"), ("c", "new c")]
    assert held(out, "facts") == [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (6, None, None)]
    assert held(out, "pages") == sorted([("p", None, "a"), ("q", "p", "b"), ("r", "q", "c"), ("u", "v", None), ("v", "u", None)], key=repr)
    told = outcomes(report)
    assert told["docs", "b"] == told["facts", "4"] == told["pages", "q"] == "skipped"
    assert told["facts", "5"] == told["pages", "s"] == told["pages", "t"] == "dangling"
    assert len(told) == sum(map(len, SENT))  # a line for every row
    assert {r.old: (r.layer, r.cycle) for r in report.where("table = 'pages'").collect()} == {"q": (0, None), "r": (1, None), "s": (0, None), "t": (1, None), "u": (None, "u"), "v": (None, "u")}


def test_replace(spark):
    out, report = transfer.imported(bank(spark, *STORE), bank(spark, *SENT), BANK, "replace")
    assert held(out, "docs") == [("a", "old a"), ("b", "new b"), ("c", "new c")]
    assert held(out, "facts") == [(1, "a", "x"), (2, "b", "Y"), (3, "c", "z"), (4, "b", "w"), (6, None, None)]
    assert ("q", None, "b") in held(out, "pages") and ("q", "p", "b") not in held(out, "pages")
    assert outcomes(report)["docs", "b"] == "replaced"


def test_new_ids_reach_every_reference(spark):
    out, report = transfer.imported(bank(spark, *STORE), bank(spark, *SENT), BANK, "new_id")
    new = {(r.table, r.old): r.new for r in report.collect()}
    b, q, two = new["docs", "b"], new["pages", "q"], int(new["facts", "2"])
    assert len({b, "b", "a", "c"}) == 4 and two > 6
    assert held(out, "docs") == sorted([("a", "old a"), ("b", "old b"), (b, "new b"), ("c", "new c")], key=repr)
    assert {(two, b, "Y"), (4, b, "w"), (2, "b", "y")} <= set(held(out, "facts"))
    assert {(q, None, b), ("r", q, "c"), ("q", "p", "b")} <= set(held(out, "pages"))
    with pytest.raises(transfer.Clash, match="before"):
        transfer.imported(out, bank(spark, *SENT), BANK, "new_id")


def test_fail_and_bad_plans(spark):
    with pytest.raises(transfer.Clash, match="docs has already: \\['b'\\]"):
        transfer.imported(bank(spark, *STORE), bank(spark, *SENT), BANK, "fail")
    with pytest.raises(ValueError, match="policy"):
        transfer.imported({}, {}, BANK, "merge")
    with pytest.raises(ValueError, match="circle"):
        transfer.ordered([Table("a", "k", {"x": "b"}), Table("b", "k", {"x": "a"})])


def test_export_import_export_is_equal(spark, tmp_path):
    first = bank(spark, *STORE)
    transfer.export(first, BANK, str(tmp_path / "one"))
    read = transfer.archive(spark, str(tmp_path / "one"), SCHEMAS)
    empty = {name: frame.limit(0) for name, frame in first.items()}
    for store, policy in ((empty, "fail"), (first, "replace"), (first, "skip")):
        out, _ = transfer.imported(store, read, BANK, policy)
        for name in SCHEMAS:
            assert held(out, name) == held(first, name), (policy, name)
    out, _ = transfer.imported(empty, read, BANK, "fail")
    transfer.export(out, BANK, str(tmp_path / "two"))
    again = transfer.archive(spark, str(tmp_path / "two"), SCHEMAS)
    assert all(held(again, n) == held(read, n) for n in SCHEMAS)


def test_layers_of_random_graphs(spark):
    draw = random.Random(4)
    for size in (1, 40):
        nodes = {k: draw.choice([None, -5, *range(size)]) for k in range(size)} | {100 + k: 99 + k if k else None for k in range(size)}
        rows = [(k, p) for k, p in nodes.items()] + [(None, 1)]
        found = {r.k: (r.layer, r.cycle, r.on_cycle) for r in transfer.layers(spark.createDataFrame(rows, "k int, p int"), "k", "p").collect()}
        for k in nodes:
            way = [k]
            while (up := nodes[way[-1]]) in nodes and up not in way:
                way.append(up)
            if nodes[way[-1]] in nodes:
                circle = way[way.index(nodes[way[-1]]) :]
                assert found[k] == (None, min(circle), k in circle)
            else:
                assert found[k] == (len(way) - 1, None, False)
        assert len(found) == len(nodes)
