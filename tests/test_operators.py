import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.operators import chunking, enrichment, fulltext, policy, vectors


def test_query_tokens():
    assert fulltext.query_tokens("what is it about") == ["about", "is", "it", "what"]
    assert fulltext.query_tokens("sync_engine parseConfig") == ["config", "engine", "parse", "parseconfig", "sync", "sync_engine"]


@given(st.text(alphabet="ab \n", max_size=300))
@settings(max_examples=100, deadline=None)
def test_windows_cover_the_text(text):
    spans = chunking.windows(text, 40, 10)
    assert (spans[0][0], spans[-1][1]) == (0, len(text)) if text else not spans
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("numeral, value", [("iv", 4), ("XIX", 19), ("mcmxc", 1990), ("abc", None)])
def test_roman(numeral, value):
    assert chunking.roman(numeral) == value


def test_symbols_and_text():
    assert ("class", "A", 1) in enrichment.symbols_of("class A: pass") and enrichment.symbols_of("def (") == []
    assert enrichment.text_of_html("<p>a</p><script>x</script><b>b</b>") == "a\nb"
    assert enrichment.normalize("Note that  the Build is GREEN.") == "build is green"


def test_stub_embedding_is_stable():
    a = vectors.stub_embedding("red car", synonyms={"automobile": "car"})
    assert a == vectors.stub_embedding("car red") and abs(sum(x * x for x in a) - 1) < 1e-9
    assert vectors.stub_embedding("") == [0.0] * 64


def test_acl_fails_closed(spark):
    rows = spark.createDataFrame([(1, "{bad"), (2, '{"public": true}'), (3, '{"allow": ["u"]}'), (4, None)], "id int, acl string")
    seen = {r["id"]: (r["u"], r["none"]) for r in rows.select("id", policy.visible(["u"], False).alias("u"), policy.visible(None, False).alias("none")).collect()}
    assert seen == {1: (False, False), 2: (True, True), 3: (True, False), 4: (True, False)}
