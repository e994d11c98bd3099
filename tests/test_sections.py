"""Sections of notes: paths of headings, outlines, narrowing."""

import pytest

from tessera.operators import sections

BODY = "lead\n\n## Ranking\nfuse\n\n### Decay\nby disuse\n```\n# none\n```\n## Storage\nfile\n# Top\n### Deep\nx\n## Ranking\nagain"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("a", BODY), ("b", "plain"), ("c", None), ("d", " \n\n"), ("e", "#not\n####### no\n#  Yes  \n")]
    return sections.split(spark.createDataFrame(rows, "id string, body string"), "id", "body").cache()


def test_split(chunks):
    got = {r.id: [] for r in chunks.collect()}
    for r in sorted(chunks.collect(), key=lambda r: (r.id, r.seq)):
        got[r.id].append((r.section, r.text))
    assert got == {
        "a": [
            (None, "lead\n"), ("H2: Ranking", "## Ranking\nfuse\n"), ("H2: Ranking > H3: Decay", "### Decay\nby disuse\n```\n# none\n```"), ("H2: Storage", "## Storage\nfile"),
            ("H1: Top", "# Top"), ("H1: Top > H3: Deep", "### Deep\nx"), ("H1: Top > H2: Ranking", "## Ranking\nagain"),
        ],
        "b": [(None, "plain")],
        "e": [(None, "#not\n####### no"), ("H1: Yes", "#  Yes  \n")],
    }


def test_outline(chunks):
    got = [r.section for r in sections.outline(chunks, "id").where("id = 'a'").orderBy("place").collect()]
    assert got == ["(preamble)", "H2: Ranking", "H2: Ranking > H3: Decay", "H2: Storage", "H1: Top", "H1: Top > H3: Deep", "H1: Top > H2: Ranking"]


def test_narrow(spark, chunks):
    asked = [("a", "H2: Ranking"), ("b", "(preamble)"), ("b", "H2: No"), ("c", "H1: X"), ("e", "H1: Yes"), ("e", "H1: Yes")]
    got = {r.id: r for r in sections.narrow(spark.createDataFrame(asked, "id string, section string"), chunks, "id").collect()}
    assert got["a"].text == "## Ranking\nfuse\n\n\n### Decay\nby disuse\n```\n# none\n```\n\n## Ranking\nagain" and got["a"].error is None
    assert got["b"].text is None and got["b"].error == "no section named H2: No; it has: (preamble)" and got["b"].matched == ["(preamble)"]
    assert got["c"].error == "no section named H1: X; it has no headings" and got["e"].text == "#  Yes  \n"
