"""A formatter that is given many files at a time."""

import sys

from corpusforge.operators import formatting as X

#: Rewrites the files that it is given; one that holds "bad" ends it. Counts its calls.
SCRIPT = """
import pathlib, sys
log, *names = sys.argv[1:]
with open(log, "a") as f:
    f.write(f"{len(names)}\\n")
texts = [pathlib.Path(n).read_text() for n in names]
if any("bad" in t for t in texts):
    sys.exit(1)
for n, t in zip(names, texts):
    pathlib.Path(n).write_text(t.upper())
"""


def test_many_files_and_one_that_fails(spark, tmp_path):
    (tmp_path / "tool.py").write_text(SCRIPT)
    command = [sys.executable, str(tmp_path / "tool.py"), str(tmp_path / "calls")]
    rows = [(i, None if i == 5 else "bad" if i == 77 else f"text {i} \u00e9") for i in range(200)]
    df = spark.createDataFrame(rows, "n int, content string").coalesce(1)
    got = {r.n: r.content for r in X.format_markdown(df, command=command, in_place=True).collect()}
    assert got == {i: t if t is None or t == "bad" else t.upper() for i, t in rows}
    calls = [int(x) for x in (tmp_path / "calls").read_text().split()]
    assert calls[0] == 199 and len(calls) < 20
    same = {i: t for i, t in rows}
    for bad in (["no-such-program"], ["false"]):
        assert {r.n: r.content for r in X.format_markdown(df, command=bad, in_place=True).collect()} == same
