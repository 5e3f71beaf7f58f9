import json

import pytest

from driftmark import cli


@pytest.fixture(scope="module")
def folder(spark, tiny, tmp_path_factory):
    """Suppliers as JSON Lines: as they are, with other balances, and without a name."""
    base = tmp_path_factory.mktemp("cli")
    rows = [r.asDict() for r in spark.read.parquet(f"{tiny}/supplier.parquet").orderBy("s_suppkey").collect()]
    write = lambda name, some: (base / name).write_text("".join(json.dumps(r) + "\n" for r in some), "utf-8")
    write("one.jsonl", rows)
    write("two.jsonl", [{**r, "s_acctbal": r["s_acctbal"] + (r["s_suppkey"] % 2)} for r in rows])
    write("bare.jsonl", [{"s_acctbal": r["s_acctbal"]} for r in rows])
    return base


@pytest.fixture
def run(spark, folder, capsys):
    """Status, output and error text of a command; names with a dot are files of the folder."""

    def call(*words):
        status = cli.main([str(folder / w) if "." in w or w.startswith("new") else w for w in words])
        return status, *capsys.readouterr()

    return call


def test_comparisons(run):
    status, out, _ = run("diff", "one.jsonl", "one.jsonl", "--key", "s_name")
    assert status == 0 and out.splitlines()[1] == "records matched by key s_name" and "no differences" in out
    status, out, _ = run("diff", "one.jsonl", "two.jsonl", "--id", "s_suppkey", "--examples", "1")
    assert status == 1 and "/s_acctbal" in out and out.count("\n  changed    ") == 2
    assert run("diff", "one.jsonl", "two.jsonl", "--id", "s_suppkey", "--ignore", "s_acctbal")[0] == 0
    status, out, _ = run("diff", "one.jsonl", "two.jsonl", "--content", "-o", "report.txt")
    assert status == 1 and out == ""


@pytest.mark.parametrize("kept", [("new.json",), ("newtables", "--tables")])
def test_snapshots_bring_their_settings(run, kept, folder):
    status, out, _ = run("snapshot", "one.jsonl", "-o", kept[0], *kept[1:], "--key", "s_name, s_nationkey", "--ignore", "none,/a/b")
    assert status == 0 and "10 records, matched by key s_name + s_nationkey" in out
    status, out, _ = run("diff", kept[0], "two.jsonl", "--json")
    found = json.loads(out)
    assert status == 1 and found["match"] == {"by": "key", "fields": ["s_name", "s_nationkey"]} and found["ignore"] == ["none", "/a/b"] and found["counts"]["changed"] == 5
    for option in (("--id", "s_name"), ("--ignore", "s_acctbal")):
        status, _, err = run("diff", "two.jsonl", kept[0], *option)
        assert status == 2 and "this snapshot has" in err


def test_what_cannot_be_done(run, folder):
    (folder / "other.json").write_text("[]", "utf-8")
    for words, said in (
        (("diff", "one.jsonl", "absent.jsonl"), "absent.jsonl"), (("diff", "bare.jsonl", "one.jsonl", "--id", "s_suppkey"), "id field 's_suppkey'"),
        (("snapshot", "one.jsonl", "-o", "one.jsonl"), "same path"), (("snapshot", "one.jsonl", "-o", "other.json"), "left as it is"),
    ):
        status, out, err = run(*words)
        assert status == 2 and out == "" and err.startswith("driftmark: ") and said in err
    for words in (("diff", "one.jsonl"), ("diff", "one.jsonl", "one.jsonl", "--id", "x", "--content"), ("diff", "one.jsonl", "one.jsonl", "--ignore", " , "), ("diff", "one.jsonl", "one.jsonl", "--key", ",")):
        with pytest.raises(SystemExit) as stop:
            run(*words)
        assert stop.value.code == 2
