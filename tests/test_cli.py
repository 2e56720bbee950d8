import json

from reflume import cli
from tests.test_docx import STYLES, p, package


def test_reports_and_exit_codes(spark, tmp_path, capsys):
    entry = "Doe, J. (2017). Citation practice. Journal of Tests, 12(3), 45-60."
    (tmp_path / "good.docx").write_bytes(package(p("Doe (2017) said.") + p("References", "Heading1") + p(entry), {"word/styles.xml": STYLES}))
    assert cli.main([str(tmp_path / "good.docx"), "--format", "json"]) == 0
    value = json.loads(capsys.readouterr().out)
    assert value["meta"]["citations"] == 2 and value["meta"]["references"] == 1 and not value["issues"]
    (tmp_path / "bad.docx").write_bytes(package(p("Roe (2001) said.")))
    assert cli.main([str(tmp_path / "bad.docx")]) == 1 and "1 issue found (ERROR: 1)" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "bad.docx"), "-d"]) == 1 and "1. [ERROR] CS001:0" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "gone.docx")]) == 2 and "file not found" in capsys.readouterr().err
    (tmp_path / "no.docx").write_bytes(b"PK nothing of the kind, just bytes")
    assert cli.main([str(tmp_path), "--severity", "CS001=info"]) == 2
    told = capsys.readouterr()
    assert "INFO: 1" in told.out and "no.docx" in told.err
