import json

from florilege.__main__ import main


def test_stages_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "g.tsv").write_text("name\taliases\nIslam\tIslam,Muslim\n")
    (tmp_path / "lex.json").write_text(json.dumps({"food": ["rice"], "drink": ["tea"]}))
    text = "Muslim people are drinking green tea in winter. Nothing here. Muslim people are eating rice."
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"text": text, "url": f"http://h{k}/"}) for k in range(3)))
    (tmp_path / "s.yaml").write_text("people_group: religions\nexcluded_filters: [root-has-nsubj-or-nsubjpass]\n")
    tables = str(tmp_path / "tables")
    main(["--config", str(tmp_path / "s.yaml"), "--tables", tables, "--corpus", str(tmp_path / "c.json"), "--gazetteer", str(tmp_path / "g.tsv"), "--lexicon", str(tmp_path / "lex.json"), "--stages", "1", "3"])
    assert spark.read.parquet(f"{tables}/religions_sentences").count() == 6
    assert spark.read.parquet(f"{tables}/religions_matches").select("node_id").distinct().collect()[0].node_id == "Islam"
    scores = spark.read.parquet(f"{tables}/religions_labels").collect()
    assert scores and all(set(r.scores) == {"food", "drink"} for r in scores)
    monkeypatch.setattr("builtins.input", lambda _: "n")
    main(["--tables", tables, "--reset"])
    assert "left" in capsys.readouterr().out and spark.read.parquet(f"{tables}/religions_labels").count() == len(scores)
