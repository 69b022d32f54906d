from eatlas.llm import mixing

from .helpers import collected, documents


def test_a_range_beyond_any_array_is_exploded_in_pieces(spark):
    row = spark.createDataFrame([(False, "a", 5, 5 + (1 << 32))], "_none boolean, _name string, lo bigint, hi bigint")
    found = mixing._each_of(row, "lo", "hi", "n", 1).limit(3).collect()
    assert len(found) == 3 and all(5 <= r["n"] <= 5 + (1 << 32) for r in found)


def test_pieces_of_ranges_give_the_same_mix(spark, monkeypatch):
    docs = documents(spark, [(i, " ".join(f"w{j}" for j in range(40 + i)), "abc"[i % 7 // 3]) for i in range(40)])
    columns = ("doc_id", "size", "source_size", "target", "taken")
    whole = collected(mixing.mix_digest(docs, 4, 16), *columns)
    monkeypatch.setattr(mixing, "_RANGE", 7)
    assert collected(mixing.mix_digest(docs, 4, 16), *columns) == whole
