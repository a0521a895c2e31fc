"""Property-based checks (hypothesis): closed forms against their definitions."""

import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanfold.functions import text as T
from spanfold.functions import tokens as K

texts = st.text(alphabet="aAbB1#é \n", min_size=0, max_size=24)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(texts, min_size=50, max_size=200))
def test_hashtags_are_resolved(spark, batch):
    """No marker before text is left, no letter is invented, text without markers stays."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string").select(
        "i", "t", T.split_hashtags(F.col("t")).alias("once"))
    rows = df.select("t", "once", T.split_hashtags(F.col("once")).alias("twice")).orderBy("i").collect()
    for r in rows:
        assert not re.search(r"#\S", r.once) and r.twice == r.once
        rest = iter(r.t)
        assert all(c in rest for c in r.once if not c.isspace())      # in order, all from the text
        if "#" not in r.t:
            assert r.once == r.t


tokens = st.one_of(st.text(alphabet="ab1:()p;<3@h.,é-", min_size=0, max_size=8),
                 st.text(alphabet="htp:/a", min_size=4, max_size=8).map(lambda s: "http" + s))


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(tokens, min_size=50, max_size=200))
def test_token_rules(spark, batch):
    """A token becomes a placeholder, stays as it is, or goes."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(K.replace_token(F.col("t"))).collect()]
    for t, out in zip(batch, got):
        assert out in (None, t, "<EMOTE>", "<URL>", "<USER>", "<NUMBER>")
        if t.isascii() and t.isalpha() and not t.startswith("http"):
            assert out == t
        if t.isascii() and t.isdigit():
            assert out == "<NUMBER>"
        if t.startswith("@") and len(t) > 1 and not any(c.isspace() for c in t):
            assert out == "<USER>"
        if out == "<URL>":
            assert t.startswith("http")


def _numeric_ref(draw_cp, hex_form, semi):
    body = (f"#x{draw_cp:x}" if hex_form else f"#{draw_cp}")
    return "&" + body + (";" if semi else "")


pieces = st.one_of(
    st.builds(_numeric_ref,
              st.one_of(st.integers(0, 0x2FF), st.integers(0x80, 0x9F), st.integers(0xD7F0, 0xE010),
                        st.integers(0xFDC0, 0xFFFF), st.integers(0x10FFF0, 0x110010),
                        st.integers(10 ** 7, 10 ** 12)),
              st.booleans(), st.booleans()),
    st.sampled_from(sorted(T.ENTITIES)).map(lambda n: "&" + n),
    st.text(alphabet="xyz ;#", min_size=0, max_size=3),
)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(pieces, min_size=1, max_size=6).map("".join), min_size=50, max_size=150))
def test_entity_decoding(spark, batch):
    import html
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(T.unescape_html(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in batch]
