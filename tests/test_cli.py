"""The command line, end to end on small files."""

import random

import pytest

from strandloom.__main__ import main


@pytest.mark.parametrize("canonical", [False, True])
def test_build_query_check_bench(spark, tmp_path, canonical):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(10)]
    (tmp_path / "a.fa").write_text("".join(f">s{i}\n{r[:40]}\n{r[40:].lower()}\n" for i, r in enumerate(rows)))
    (tmp_path / "q.txt").write_text("\n".join([rows[0][:21], rows[1][5:26].lower(), "ACGT", "N" * 21, "A" * 21]))
    (tmp_path / "bad.fa").write_text(">x\nACGTNACGT\n")
    index = str(tmp_path / "index")
    run = lambda *a: dict(x.split(": ") for x in main(list(a), spark).splitlines() if ": " in x)
    built = run("build", "-i", str(tmp_path / "a.fa"), "-o", index, "-k", "21", "-m", "7", "-v", *["--canonical"] * canonical)
    assert (built["num_strings"], built["total_bases"], built["num_kmers"]) == ("10", "600", "400")
    found = run("query", "-i", index, "-q", str(tmp_path / "q.txt"))
    assert (found["found"], found["not_found"], found["total"], found["hit_rate"]) == ("2", "3", "5", "40.0")
    scanned = run("query", "-i", index, "-q", str(tmp_path / "a.fa"), "--streaming")
    assert (scanned["found"], scanned["searches"], scanned["extensions"]) == ("400", "10", "390")
    assert "all found" in main(["check", "-i", index, "-f", str(tmp_path / "a.fa")], spark)
    assert run("check", "-i", index, "-f", str(tmp_path / "a.fa"), "--streaming")["mismatches"] == "0"
    assert len(run("bench", "-i", index, "--rows", "1000")) == 3
    with pytest.raises(Exception, match="letters other"):
        main(["build", "-i", str(tmp_path / "bad.fa"), "-o", str(tmp_path / "no"), "-k", "3", "-m", "2"], spark)
