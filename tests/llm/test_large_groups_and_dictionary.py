"""Large candidate groups end in few rounds, and every secret scan takes one dictionary."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import queries, secrets, simhash


def test_a_chain_of_gradual_changes_ends_in_few_rounds(spark, monkeypatch):
    """Texts that each share 0.9 with the next: one group, of which a round settles little."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(12_000)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 200])) for i in range(1150)] + [(5000 + i, " ".join(words[3 * i : 3 * i + 9])) for i in range(30)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    rounds, plain = [], simhash.distances
    monkeypatch.setattr(simhash, "distances", lambda *a: rounds.append(1) or plain(*a))
    got = {r.doc_id for r in simhash.keep_one_of_each(docs, large_group=60_000).collect()}
    assert got == {0, *range(5000, 5030)} and simhash.CENTER_ROUNDS <= len(rounds) <= 20


PLANTED = """secret_key: mountain-river and db_password = configuration; api_token: environment
DB_PASS=process.env.DB_PASSWORD access_key: ${ACCESS_KEY} auth_token = $TOKEN_FROM_SHELL private_key: config.private_key
login_secret: q8Zt+Lw2!vR9xK my_passphrase is "x7#Kd9$mQ2pL" token: config.x7Kd9mQ2pLw8vR3s"""


def test_the_pipeline_and_the_query_take_one_dictionary(spark, tmp_path):
    rows = [(i, line, "en", "s", len(line or "")) for i, line in enumerate([*PLANTED.split("\n"), None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spans = {r.doc_id: r.spans for r in queries.op2_secrets(spark, str(tmp_path)).collect()}
    texts = {r.doc_id: r.text for r in corpus_pipeline.secret_scans(spark, docs, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        want, at, held = "", 0, []
        for start, end in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in spans[i].split(",") if s)):
            if held and start < held[-1][1]:
                held[-1][1] = max(held[-1][1], end)
            else:
                held.append([start, end])
        for start, end in held:
            want, at = want + text[at:start] + "[SECRET]", end
        assert texts[i] == (None if text is None else want + text[at:])
    guesses = {text[int(a) : int(b)] for i, text, *_ in rows for k, a, b in (s.split(":") for s in spans[i].split(",") if s) if k == "guess"}
    assert guesses == {"q8Zt+Lw2!vR9xK", "x7#Kd9$mQ2pL"}


def test_references_to_variables_are_no_secrets():
    for value in ("$DB_PASSWORD", "${DB_PASSWORD}", "${DB_PASS:-none}", "%DB_PASSWORD%", "process.env.DB_PASSWORD", "os.environ.X1", "{{vault.pass}}", "settings.db?.password"):
        assert secrets.REFERENCE.fullmatch(value), value
    for value in ("q8Zt+Lw2", "$2b$12$abcdefghijk", "eyJhbGci.eyJzdWIi.SflKxw", "12345", "process.env.a-b", "%41bc"):
        assert not secrets.REFERENCE.fullmatch(value), value


def test_a_missing_dictionary_is_an_error(spark):
    docs = spark.createDataFrame([(1, "password: x")], "doc_id long, text string")
    with pytest.raises(ValueError, match="vocabulary"):
        secrets.find_secrets(docs, vocabulary="/nowhere/words.json")
    assert secrets.find_secrets(docs, vocabulary=None).select(F.sum("n_guess")).first()[0] == 0
