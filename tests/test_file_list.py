"""File lists of any length."""

from lectern.sources import readers


def test_more_than_a_thousand_models(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("peer1 " + " ".join(f"m{i}" for i in range(1500)) + "\n")
    _, models = readers.read_file_list(spark, str(path))
    assert sorted(r.file for r in models.collect()) == sorted(f"m{i}" for i in range(1500))
