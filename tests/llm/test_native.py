"""Secret scans, line dedup and quality rules against plain Python."""

import collections
import hashlib
import re

import pytest
from llm.odd import none_of, odd_docs
from oracle import differences, duck
from pyspark.sql import functions as F

from lodestream.llm import linededup, quality, secrets, trigram

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- secrets


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def check_secrets(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id])
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]


def test_secrets(spark):
    texts = {r.doc_id: r.text for r in _docs(spark).collect()}
    rows = secrets.op1_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    check_secrets(rows, texts)


def test_secrets_by_sql(spark):
    assert differences(secrets.op1_secret_scan(spark, SF), duck(SF), secrets.OP1_SQL) == ""


TRICKY = ["api_key: 'short'", "PASSWORD=\"longenough\"", "token=abc token=abcdefgh", "secret  =  x.y-z_1/2+3=", "AKIA" + "B" * 15, "AKIA" + "B" * 16, "\U0001f600é" + "0a" * 12, "f" * 23, "f" * 24 + "g" + "e" * 30, "apikey=password=abcdefg", "passwd:İtoken=123456", "tokKen=123456", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "postgres://u:p@h"]


def test_tricky_secrets(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(TRICKY)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op1_secret_scan(spark, str(tmp_path)).collect()
    check_secrets(rows, dict(docs))
    got = {r.doc_id: r.spans for r in rows}
    assert got[12].startswith("github:0:40")
    assert got[13] == "private_key:0:31"
    assert got[14] == "url_login:0:15"


def test_many_secrets_in_a_text(spark, tmp_path):
    """A dump of 60,000 keys, and texts of one to ten: places add up in any number of blocks."""
    docs = [(n, " ".join(f"token={'k' * (6 + i % 5)} é{'ab' * 12}" for i in range(n))) for n in (*range(1, 11), 30_000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_secrets(secrets.op1_secret_scan(spark, str(tmp_path)).collect(), dict(docs))


def test_secrets_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = secrets.scan(docs).collect()
    assert len(got) == docs.count()
    assert {len(r.spans) for r in got if not r.text} == {0}
    assert [len(r.spans) for r in got if r.doc_id == 11] == [2]
    assert secrets.scan(none_of(docs)).count() == 0
    assert "abcdef12" not in [r.text for r in secrets.redact(docs).collect() if r.doc_id == 11][0]
    assert secrets.redact(docs).columns == docs.columns


@pytest.mark.parametrize(("pattern", "text"), [("abcd", "xxabcdxx"), ("(foo|bar)baz", "barbaz"), ("ab+cde", "abbbcde"), ("(?i)HeLLo", "hello"), ("a[bc]def", "acdef"), ("x?yzw", "yzw"), ("[0-9]{4}", "1234"), ("ghp_[A-Z]{3}", "ghp_ABC")])
def test_trigrams_of_matches_are_in_the_text(pattern, text):
    assert re.search(pattern, text)
    assert any(all(t in text.lower() for t in clause) for clause in trigram.trigram_query(pattern))


def test_patterns_without_trigrams_scan_all():
    assert trigram.trigram_query("[0-9a-f]{24,}") == trigram.ANY
    assert trigram.trigram_query("(foo|[a-z]+)") == trigram.ANY
    assert trigram.trigram_query("password") != trigram.ANY


# ---- lines


def by_hand(docs, sites=linededup.SITES):
    """doc_id, site, text -> doc_id, text without boilerplate."""
    spread, first = collections.defaultdict(set), {}
    for i, site, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            if text is not None and WORD.search(line):
                if site is not None:
                    spread[line].add(site)
                first.setdefault(line, (i, pos))
    gone = {x for x, s in spread.items() if len(s) >= sites}
    return [(i, text if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if x not in gone or first[x] == (i, p))) for i, _, text in docs]


def test_lines(spark):
    docs = [(r.doc_id, r.source, r.text) for r in _docs(spark).select("doc_id", "source", "text").collect()]
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(_docs(spark)).collect())
    want = sorted(by_hand(docs))
    assert got == want
    assert any(a != b for (_, a), (_, _, b) in zip(want, sorted(docs), strict=True))


def test_lines_by_sql(spark):
    assert differences(linededup.op3_line_dedup(spark, SF), duck(SF), linededup.OP3_SQL) == ""


@pytest.mark.parametrize("sites", [2, 3, 5, 40])
def test_lines_near_the_threshold(spark, sites):
    rows = [(100 * n + k, f"site{k}", f"spread over {n}\nown {n} {k}") for n in range(1, 60, 3) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df, sites).collect()) == sorted(by_hand(rows, sites))


def test_common_lines(spark):
    """A line on a third of all rows, one just below what counts as common, and lines on few rows."""
    rows = [(i, f"site{i % 7}", ("everywhere\n" if i % 3 == 0 else "") + ("rare\n" if i in (5, 50, 501) else "") + f"own {i}\nother {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup_lines(df).collect()) == sorted(by_hand(rows))


def test_lines_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = linededup.dedup_lines(docs, removed="n_removed").collect()
    assert len(got) == docs.count()
    assert sorted(got[0].asDict()) == sorted([*docs.columns, "n_removed"])
    assert all(r.text is None for r in got if r.doc_id == 2)
    assert linededup.dedup_lines(none_of(docs)).count() == 0


# ---- quality


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality(spark):
    texts = {r.doc_id: r.text for r in _docs(spark).collect()}
    rows = quality.op5_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == measured(texts[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
    assert 0 < sum(r.kept for r in rows)


def test_quality_by_sql(spark):
    assert differences(quality.op5_quality_rules(spark, SF), duck(SF), quality.OP5_SQL) == ""


def test_quality_filter_is_the_query(spark):
    kept = {r.doc_id for r in quality.op5_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in _docs(spark).where(quality.is_kept(F.col("text"))).collect()} == kept


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    got = quality.quality(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measured(r.text)
    assert quality.quality(none_of(docs)).count() == 0


def test_quality_plan_has_no_python(spark):
    plan = quality.op5_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
