"""Keys, descriptions, boxes of a graph, and pruning."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from brindle.sources import schemas
from brindle.sources.boxes import Boxes, parse_schema


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_keys_of_a_database(spark, tmp_path):
    path = str(tmp_path / "k.sqlite")
    with sqlite3.connect(path) as con:
        con.executescript("CREATE TABLE a (x INTEGER, y TEXT, PRIMARY KEY (y, x)); CREATE TABLE b (id INTEGER PRIMARY KEY, y TEXT, x INTEGER, c INTEGER REFERENCES c, FOREIGN KEY (y, x) REFERENCES a (y, x)); CREATE TABLE c (id INTEGER PRIMARY KEY); CREATE TABLE d (v TEXT)")
    own, links = schemas.sqlite_keys(spark, path)
    assert rows(own) == [("a", "y,x", "primary"), ("b", "id", "primary"), ("c", "id", "primary")]
    assert rows(links) == [("b", "c", "c", "id"), ("b", "x", "a", "x"), ("b", "y", "a", "y")]
    assert rows(schemas.target_of(links, "b", "c")) == [("c", "id")]


def test_boxes_of_a_graph_are_written_and_read_back(spark, tmp_path):
    triples = spark.createDataFrame([("alice", "type", "person"), ("alice", "type", "poet"), ("alice", "born_in", "paris"), ("paris", "type", "city"), ("paris", "country", 'the "old", France'), ("x", "born_in", "rome")], "s string, p string, o string")
    boxes = schemas.graph_boxes(triples)
    assert {k: v.columns for k, v in boxes.items()} == {"city": ["city", "country"], "entity": ["entity", "born_in"], "person": ["person", "born_in"], "poet": ["poet", "born_in"]}
    assert rows(boxes["person"]) == rows(boxes["poet"]) == [("alice", "paris")] and rows(boxes["entity"]) == [("x", "rome")]
    assert list(schemas.graph_boxes(triples, ["country"])) == ["city"]
    links = schemas.write_boxes(boxes, str(tmp_path / "kg"))
    assert ("city-city", "person-born_in") in rows(links)
    read = schemas.read_boxes(spark, str(tmp_path / "kg"), boxes)
    assert {k: rows(v) for k, v in read.items()} == {k: rows(v) for k, v in boxes.items()}
    own, found = schemas.graph_keys(spark, read, str(tmp_path / "kg" / "foreign_key.json"))
    assert ("city", "city", "primary") in rows(own) and ("city", "city", "person", "born_in") in rows(found) and found.count() == links.count()


def test_descriptions_reach_the_schema_text(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbforiginal_column_name,column_name,column_description,value_description\nid,ID,the key,\n Name ,n,caf\xe9 name,\"a, b\"\nnone,,,\n")
    meanings = schemas.described(spark, {"people": str(tmp_path / "a.csv")})
    assert rows(meanings.where("meaning IS NOT NULL")) == [("people", "Name", "café name; a, b"), ("people", "id", "the key")]
    boxes = Boxes(spark)
    boxes.add_all(schemas.with_meanings({"People": spark.createDataFrame([(1, "x", 2)], "ID int, name string, other int")}, meanings))
    assert parse_schema(boxes.schema_text())["People"] == {"ID": ("int", "the key"), "name": ("string", "café name; a, b"), "other": ("int", "")}


def test_tables_by_id_and_pruned(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "t7.csv").write_text("a,b\n1,2\n")
    assert rows(schemas.table_by_id(spark, str(tmp_path), "t7")) == [("1", "2")]
    with pytest.raises(FileNotFoundError):
        schemas.table_by_id(spark, str(tmp_path), "t8")
    boxes = Boxes(spark)
    boxes.add_all({"one": spark.range(2).withColumn("a", F.lit(1)), "two": spark.range(0), "three": spark.range(1)})
    assert list(schemas.filled(boxes.frames)) == ["one", "three"]
    keys = spark.createDataFrame([("one", "id", "primary"), ("two", "id", "primary")], schemas.KEYS)
    links = spark.createDataFrame([("one", "a", "three", "id"), ("two", "id", "one", "id")], schemas.LINKS)
    left, own, pairs = schemas.kept_tables(boxes, keys, links, ["ONE", "three"])
    assert list(left.frames) == ["one", "three"] and rows(own) == [("one", "id", "primary")] and rows(pairs) == [("one", "a", "three", "id")]
    assert schemas.table_of(["a", "z"], boxes) == "one" and schemas.table_of(["id"], boxes) == "one" and schemas.table_of(["id"], boxes, ["three"]) == "three" and schemas.table_of(["z"], boxes) is None
    text = schemas.context(left, own, pairs)
    assert text["foreign_keys"] == "one.a = three.id" and text["primary_keys"] == "one: id" and 'three: ["0"]' in text["samples"]
