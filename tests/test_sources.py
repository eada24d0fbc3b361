import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessella.sources import dumps, records, snapshots


@pytest.mark.parametrize("layout", ["INSERT INTO `page` VALUES {0},{1},{2};\n", "INSERT INTO `page` VALUES\n{0},\n{1},\n{2};\n"])
def test_mysql_dump(spark, tmp_path, layout):
    tuples = ("(1,0,'It\\'s \"x\"',NULL)", "(2,14,'a\\\\b, (c)','q')", "(3,0,'Zwei''s',0.5)")
    head = "-- dump\nCREATE TABLE `other` (\n  `x` int\n);\nCREATE TABLE `page` (\n  `page_id` int(8),\n  `page_namespace` int(11),\n  `page_title` varbinary(255),\n  `extra` text,\n  PRIMARY KEY (`page_id`)\n) ENGINE=InnoDB;\n"
    path = str(tmp_path / "page.sql.gz")
    with gzip.open(path, "wt") as file:
        file.write(head + layout.format(*tuples) + "INSERT INTO `other` VALUES (9);\n")
    rows = dumps.mysql_dump(spark, path, "page", ["page_title", "page_id", "extra"]).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [("It's \"x\"", "1", None), ("a\\b, (c)", "2", "q"), ("Zwei's", "3", "0.5")]


def test_turtle(spark, tmp_path):
    text = '@prefix gndo: <https://d-nb.info/standards/elementset/gnd#> .\n<https://d-nb.info/gnd/1> a gndo:Person ; # note\n  gndo:name "A \\"q\\" \\u00e9" ,\n    "B. C." ;\n  owl:sameAs <http://x/Q1> .\n<https://d-nb.info/gnd/2> gndo:name """long\nname"""@de .\n'
    path = str(tmp_path / "gnd.ttl.gz")
    with gzip.open(path, "wt") as file:
        file.write(text)
    rows = {tuple(r) for r in dumps.turtle(spark, path).collect()}
    one, two = "https://d-nb.info/gnd/1", "https://d-nb.info/gnd/2"
    assert rows == {(one, "a", "gndo:Person"), (one, "gndo:name", 'A "q" é'), (one, "gndo:name", "B. C."), (one, "owl:sameAs", "http://x/Q1"), (two, "gndo:name", "long\nname")}


def test_catalogue_and_metalink(spark, tmp_path):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>u:1</id><title>T</title><name>wiki_de</name><flavour>mini</flavour><updated>2026-09-01T00:00:00Z</updated><tags>a;b</tags><link rel="self" href="x"/><link rel="http://opds-spec.org/acquisition/open-access" type="application/x-zim" href="http://h/f.zim" length="12"/></entry><entry><id>u:2</id><name>wiki_en</name><flavour></flavour><updated>2026-08-01T00:00:00Z</updated><link rel="self" href="x"/></entry></feed>'
    (tmp_path / "feed.xml").write_text(atom)
    rows = records.catalogue(spark, str(tmp_path / "feed.xml")).orderBy("id").collect()
    assert [(r.id, str(r.updated), r.tags, r.href, r.length) for r in rows] == [("wiki_de_mini", "2026-09-01", ["a", "b"], "http://h/f.zim", 12), ("wiki_en", "2026-08-01", None, None, None)]
    (tmp_path / "f.meta4").write_text('<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="f.zim"><size>12</size><hash type="md5">aa</hash><hash type="sha-256">bb</hash><url priority="2">u2</url><url priority="1">u1</url></file></metalink>')
    row = records.metalink(spark, str(tmp_path / "f.meta4")).first()
    assert (row["name"], row["size"], row.sha256, row.urls) == ("f.zim", 12, "bb", ["u1", "u2"])


def test_repository_records(spark, tmp_path):
    node = lambda i, **p: {"ref": {"id": i}, "title": f"t{i}", "properties": p}
    pages = [{"page": 1, "nodes": [node("a", **{"cclom:title": ["A"], "ccm:taxonid": ["http://v/subject/380/"], "cclom:general_keyword": ["k", "k", "l"]}), node("b")]}, {"page": 2, "nodes": [node("a", **{"cclom:title": ["later"]}), node("c", **{"ccm:taxonid": ["http://v/1"], "ccm:taxonid_DISPLAYNAME": ["Physik"]})]}]
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, pages)))
    rows = {r.id: r for r in records.repository_records(spark, str(tmp_path / "pages.json")).collect()}
    assert len(rows) == 3 and rows["a"].title == "A" and rows["a"].subjects == ["380"] and rows["a"].keywords == ["k", "l"]
    assert rows["b"].title == "tb" and rows["b"].subjects == [] and rows["c"].subjects == ["Physik"]


def test_gold_labels_both_ways(spark, tmp_path):
    lines = [{"_meta": {"topic": "Optik", "template_id": "x"}}, {"chunk_id": "s:c000", "slot": "a", "text_hash": "0f", "heading": "H; \"q\"", "text_head": "ä"}, {"chunk_id": "s:c001", "slot": "none", "text_hash": "10", "heading": "", "text_head": "b"}]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, lines)))
    labels = records.gold_labels(spark, str(tmp_path / "gold.jsonl"))
    assert [(r.chunk_id, r.slot) for r in labels.orderBy("chunk_id").collect()] == [("s:c000", "a"), ("s:c001", None)]
    records.write_gold_csv(labels, str(tmp_path / "csv"))
    back = records.gold_csv(spark, str(tmp_path / "csv")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.slot, r.heading, r.text_head) for r in back] == [("s:c000", "a", 'H; "q"', "ä"), ("s:c001", None, None, "b")]


def test_snapshots_swap_and_guard(spark, tmp_path):
    root = str(tmp_path / "store")
    assert snapshots.current(spark, root) is None
    rows = spark.range(100).withColumn("state", F.col("id") % 4)
    snapshots.publish(rows, root, snapshots.refuse_losses("state"))
    with pytest.raises(ValueError, match="lost of 2"):
        snapshots.publish(rows.where("state <> 2 OR id < 20"), root, snapshots.refuse_losses("state"))
    assert snapshots.current(spark, root).count() == 100
    snapshots.publish(rows.where("id < 60"), root, snapshots.refuse_losses("state"))
    assert snapshots.current(spark, root).count() == 60
