import json
import struct
import subprocess
import sys
import zlib
from pathlib import Path

from docsift.cli import main

REPO = Path(__file__).parent.parent


def test_command_line(spark, tmp_path, capsys):
    one, two = tmp_path / "p1.txt", tmp_path / "p2.txt"
    one.write_text("SMS: 5\nx", encoding="utf-8")
    two.write_text("Mã gói: ABC9\nSMS: 6\nChu kỳ: ngày", encoding="utf-8")
    out = tmp_path / "deep" / "record.json"
    assert main(["--text-file", str(one), str(two), "--out", str(out), "--debug"]) == 0
    record = json.loads(out.read_text(encoding="utf-8"))
    assert (record["packageCode"], record["sms"], record["cycle"], record["dataGB"]) == ("ABC9", 6, "ngày", None) and len(record) == 11
    assert "sms = 6 [table" in capsys.readouterr().err
    assert main(["--text-file", str(tmp_path / "none.txt")]) == 1 and main(["--text-file", str(one), "--schema", str(tmp_path / "none.json")]) == 1


def test_pages_are_in_the_order_given_whatever_their_names(spark, tmp_path, capsys):
    names = ["b/p.txt", "a/p.txt", "c d/tảo bẹ.txt"]
    for k, name in enumerate(names):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"SMS: {k + 1}\nkelp", encoding="utf-8")
    for order in ([0, 1, 2], [2, 0, 1]):
        assert main(["--text-file", *(str(tmp_path / names[k]) for k in order)]) == 0
        assert json.loads(capsys.readouterr().out)["sms"] == order[0] + 1  # pages are alike, so the first one counts


def test_images_and_engines_by_plug_in(spark, tmp_path, capsys, monkeypatch):
    from docsift.sources import readers

    monkeypatch.setattr(readers, "ENGINES", {})
    image = tmp_path / "p.png"
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    image.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(bytes(8 * 9))) + part(b"IEND", b""))
    assert main(["--image", str(image)]) == 1 and "no recogniser" in capsys.readouterr().err
    assert main(["--list-engines"]) == 0 and capsys.readouterr().out == "engines: none\n"
    (tmp_path / "plug.py").write_text(
        "from docsift.sources import readers\n"
        "class One:\n"
        "    prepares = False\n"
        "    def tokens(self, height, width, channels, data):\n"
        "        return [dict(text=t, x1=x, y1=y, x2=x + 40.0, y2=y + 9.0) for t, x, y in (('SMS', 0.0, 0.0), ('52', 90.0, 0.0), ('kelp', 0.0, 20.0))]\n"
        "readers.register_engine('one', lambda: True, One)\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    assert main(["--plugin", "plug", "--list-engines"]) == 0 and capsys.readouterr().out == "engines: one\n"
    assert main(["--plugin", "plug", "--image", str(image), "--image", str(image), "--no-binarize", "--strict-engine", "--engine", "one"]) == 0
    assert json.loads(capsys.readouterr().out)["sms"] == 52
    assert main(["--pdf", str(image)]) == 1 and main(["--image", str(image), "--engine", "two"]) == 1 and main(["--image", str(tmp_path / "none.png")]) == 1


def test_entry_imports_without_the_llm_parts(tmp_path):
    """The contract's module works where the subpackage and the pipeline were deleted."""
    for part in ("docsift", "__spark_entry__.py"):
        source, target = REPO / part, tmp_path / part
        if source.is_dir():
            for f in source.rglob("*"):
                if f.suffix in (".py", ".json") and "llm" not in f.relative_to(source).parts:
                    (target / f.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
                    (target / f.relative_to(source)).write_bytes(f.read_bytes())
        else:
            target.write_bytes(source.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'text_extract' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
