"""The entities of a linked graph are computed once, however often its document needs them."""

from curalis.sources import canonical


def test_entities_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    e = spark.createDataFrame([(f"#e{i:02d}", '{"@id":"#e%02d"}' % i) for i in range(20)], "id string, json string").mapInPandas(run, "id string, json string")
    canonical.write_graph(e, str(tmp_path / "g"), "c", {"@id": "d"}, {"@id": "./"}, part_rows=7)
    canonical.join_parts(str(tmp_path / "g"), str(tmp_path / "g.json"))
    ids = [f'{{"@id":"#e{i:02d}"}}' for i in range(20)]
    assert (tmp_path / "g.json").read_text() == '{"@context":"c","@graph":[{"@id":"d"},{"@id":"./","hasPart":[' + ",".join(ids) + "]}," + ",".join(ids) + "]}"
    assert seen.value == 20
