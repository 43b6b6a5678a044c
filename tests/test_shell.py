import io

from tripleloom.__main__ import main

FACTS = '<h:a> <h:p> <h:b> .\n<h:b> <h:p> <h:c> .\n<h:a> <h:n> "x" .\n'


def run(monkeypatch, capsys, args, lines):
    monkeypatch.setattr("sys.stdin", io.StringIO("\n".join(lines)))
    assert main(args) == 0
    return capsys.readouterr()


def test_queries_faults_and_plans(spark, monkeypatch, capsys, tmp_path):
    (tmp_path / "a.nt").write_text(FACTS)
    out = run(monkeypatch, capsys, [f"file://{tmp_path}"], ["SELECT ?x ?n WHERE { ?x <h:p> ?y OPTIONAL { ?x <h:n> ?n } }", "SELECT", "", "explain SELECT ?x WHERE { ?x <h:p> ?y }", "quit", "SELECT ?never WHERE { ?never <h:p> ?y }"])
    lines = out.out.splitlines()
    assert sorted(lines[:2]) == ["h:a|x", "h:b|"]
    assert any(line.startswith("scan ?x <h:p> ?y") for line in lines) and "never" not in out.out
    assert "error:" in out.err and "3 facts" in out.err and "0 statements skipped" in out.err


def test_silent_and_summary(spark, monkeypatch, capsys, tmp_path):
    (tmp_path / "a.nt").write_text(FACTS)
    text = "SELECT ?x ?z WHERE { ?x <h:p> ?y . ?y <h:p> ?z }"
    assert run(monkeypatch, capsys, [f"file://{tmp_path}", "-s"], [text]).out == ""
    assert run(monkeypatch, capsys, [f"file://{tmp_path}", "--summary", "--hash-parts", "2"], [text, "\\q"]).out == "h:a|h:c\n"
    (tmp_path / "parts.txt").write_text("100\n101\n100\n")
    (tmp_path / "terms.txt").write_text("h:a\nh:b\nh:c\n")
    args = [f"file://{tmp_path}", "--summary", "--parts", f"file://{tmp_path}/parts.txt", "--dict", f"file://{tmp_path}/terms.txt"]
    assert run(monkeypatch, capsys, args, [text]).out == "h:a|h:c\n"
