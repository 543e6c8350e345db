
import numpy as np
import pytest

from tidemark.operators import enrich, subjects
from tidemark.sources import readers, sinks
from tidemark.streaming import ingest



def test_hypergeometric_tail(spark):
    rows = spark.createDataFrame([(3, 20, 15, 1000), (0, 20, 15, 1000), (15, 15, 15, 15)], "x_hits long, n_list long, k_family long, m_total long")
    p = [r.p_value for r in enrich.hypergeometric(rows).orderBy("m_total", "x_hits").collect()]
    assert p == pytest.approx([1.0, 1.0, 0.002675002339720375], rel=1e-11)


def test_benjamini_hochberg(spark):
    rows = spark.createDataFrame([("a", str(i), p) for i, p in enumerate([0.01, 0.04, 0.03, 0.2, 0.03, 0.5])], "list_name string, term string, p_value double")
    for alpha, n in ((0.05, 0), (0.06, 4)):
        got = enrich.benjamini_hochberg(rows, alpha).orderBy("term").collect()
        assert [round(r.q_value, 9) for r in got] == [0.06, 0.06, 0.06, 0.24, 0.06, 0.5] and sum(r.significant for r in got) == n


def test_mass_window(spark):
    q = spark.createDataFrame([("q", 100.0)], "query string, m double")
    m = spark.createDataFrame([("a", 100.0), ("b", 100.0005), ("c", 100.0011), ("d", 99.9989)], "compound string, mass double")
    assert {r.compound for r in enrich.match_masses(q, m, 10).collect()} == {"a", "b"}


def test_list_shapes_and_labels(spark):
    bridge = spark.createDataFrame([("hsa:1", "p"), ("hsa:2", "p"), ("hsa:2", "q"), ("hsa:3", "q")], "id string, term string")
    run = lambda data, **o: {r.term: (r.n_list, r.k_family, r.m_total, r.x_hits) for r in enrich.enrich(enrich.normalise_lists(spark, data), bridge, prefix="hsa:", **o).collect()}
    assert run(["1", "2", "9"]) == run([["1"], ["2"], ["9"]]) == {"p": (2, 2, 3, 2), "q": (2, 2, 3, 1)}
    labelled = [["1", "RNA"], ["1", "Protein"], ["2", "RNA"]]
    assert run(labelled)["p"] == (2, 2, 3, 2)
    assert run(labelled, multiple_lists=True, correction="auto")["p"] == (3, 4, 6, 3)
    assert set(run({"x": ["1"], "y": [["3", "100.1", "5", "RNA"]]})) == {"p", "q"}


def test_report_files(spark, tmp_path):
    bridge = spark.createDataFrame([("1", "p"), ("2", "p")], "id string, term string")
    terms = spark.createDataFrame([("p", "name of p", "process")], "term string, name string, namespace string")
    found = enrich.enrich(enrich.normalise_lists(spark, {"l1": [["1", "RNA"], "2"], "l2": ["2"]}), bridge, terms)
    sinks.write_report(found, str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert {(r.sheet, r.hits) for r in back.collect()} == {("l1", "1 (RNA), 2"), ("l2", "2")}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_report(found, str(tmp_path / "r"), overwrite=False)


def test_matrix_and_store(spark, tmp_path):
    (tmp_path / "m.csv").write_text("source,id,0,1.5,2\na,x,1,,3\na,y,nan,2,4\n")
    s, times = readers.matrix_csv(spark, str(tmp_path / "m.csv"))
    assert times == [0, 1.5, 2] and {r.id: r.x for r in s.collect()} == {"x": [1, None, 3], "y": [None, 2, 4]}
    store = readers.Store(spark, str(tmp_path / "s"))
    assert store.read("none") is None
    store.write(s, "m")
    store.write(s, "m", json=True)
    assert store.read("m").count() == store.read("m", json=True).count() == 2


def test_annotation_readers(spark, tmp_path):
    (tmp_path / "o.obo").write_text("format-version: 1.2\n\n[Term]\nid: T:1\nname: one: a\nnamespace: process\n\n[Typedef]\nid: x\n\n[Term]\nid: T:2\nname: two\nnamespace: function\nis_obsolete: true\n")
    assert {(r.term, r.name, r.namespace) for r in readers.ontology(spark, str(tmp_path / "o.obo")).collect()} == {("T:1", "one: a", "process"), ("T:2", "two", "function")}
    (tmp_path / "g.gaf").write_text("!comment\nDB\tP1\ts\t\tT:1\nDB\tP1\ts\t\tT:1\nDB\t\ts\t\tT:1\nDB\tP2\ts\t\t\nDB\tP3\n")
    assert [(r.id, r.term) for r in readers.annotations(spark, str(tmp_path / "g.gaf")).collect()] == [("P1", "T:1")]
    (tmp_path / "k.tsv").write_text("path:1\thsa:1\npath:1\thsa:2\n")
    assert {r.id for r in readers.links(spark, str(tmp_path / "k.tsv")).collect()} == {"hsa:1", "hsa:2"}
    (tmp_path / "d.csv").write_text("cpd:C1,100.5\ncpd:C2,7\n")
    assert {(r.species, r.mass) for r in readers.masses(spark, str(tmp_path / "d.csv")).collect()} == {("cpd", 100.5), ("cpd", 7.0)}
    (tmp_path / "mol.csv").write_text('"10","cpd:C1"\n"","cpd:C2"\n')
    assert {(r.pumchem, r.cpd) for r in readers.molecules(spark, str(tmp_path / "mol.csv")).collect()} == {("10", "cpd:C1"), (None, "cpd:C2")}


def test_cross_reference(spark):
    main = spark.createDataFrame([("k1", "U1"), ("k2", "")], "kg_id string, uniprot string")
    kegg = spark.createDataFrame([("k1", "hsa+7")], "kg_id string, kegg string")
    assert {(r.kg_id, r.uniprot, r.kegg) for r in readers.cross_reference(main, kegg).collect()} == {("k1", "U1", "7"), ("k2", None, None)}


def test_association_parser():
    got = readers.parse_associations('<|"a" -> {1, -2.5, 3.*^-2, Missing[]}, {"b", "c\\"d"} -> <||>|>')
    assert got == [("->", "a", [1, -2.5, 0.03, None]), ("->", ["b", 'c"d'], [])]
    with pytest.raises(ValueError):
        readers.parse_associations("{1, 2")


def test_classified_signals(spark, tmp_path):
    (tmp_path / "c").write_text('<|"f1" -> <|{"P1", "Protein"} -> {{0.6, 0.8}, {0., Missing[], 1.}}|>, "SpikeMax" -> <||>|>')
    rows = readers.classified_signals(spark, str(tmp_path / "c")).collect()
    assert [tuple(r) for r in rows] == [("f1", "P1", "Protein", [0.6, 0.8], [0.0, None, 1.0])]


def test_subjects(spark):
    pairs = spark.createDataFrame([("a1", "b1", "g+1"), ("a1", "b1", "h+2"), ("a1", "c1", "g+1"), ("b1", "c1", "g+1"), ("a1", "d2", "h+2")], "subj_a string, subj_b string, gene string")
    part = spark.createDataFrame([("a1", 0), ("b1", 0), ("c1", 0), ("d2", 0)], "subject string, community int")
    assert [(r.community, r.gene) for r in subjects.common_genes(pairs, part, "1").collect()] == [(0, "g+1")]
    s = spark.createDataFrame([("p", 1, [1.0, 2.0, 3.0]), ("q", 1, [1.0, 2.0, 3.5]), ("p", 2, [0.0, 1.0, None]), ("q", 2, [9.0, 0.0, 1.0])], "subject string, id int, x array<double>")
    r = subjects.links_by_distance(s, 1.0).first()
    assert (r.linked, r.common, r.ids) == (1, 2, [1])
    r = subjects.links_by_correlation(s, 0.9).first()
    assert (r.linked, r.common, r.ids) == (1, 2, [1])


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "40 days")
    q.awaitTermination()
    # another batch far ahead closes all days of the first
    last = events.limit(1).selectExpr("event_id", "ts + interval 200 days as ts", "user_id", "event_type", "value", "props")
    last.write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "40 days").awaitTermination()
    got = {(r.id, r.t): r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.id, r.t): r.x for r in ingest.daily_cells(events).collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
