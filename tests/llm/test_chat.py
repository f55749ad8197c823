import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftpool.llm.chat import TEMPLATE, conversation_digest, format_conversations, read_back
from siftpool.llm.template import CONTROL, Node, TemplateError, compiled, escape, fold, parse, unescape

ODD = st.lists(st.sampled_from([*CONTROL, "\\", "<", "/", "s>", "]", "[", "I", "\n", "a", " "]), max_size=9).map("".join)


@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), ODD), ODD), max_size=5))
def test_round_trip(turns):
    for _, t in turns:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in CONTROL)
    chunks = compiled(TEMPLATE)(messages=iter([{"role": r, "text": t} for r, t in turns]))
    assert list(read_back(chunks)) == [(r, t, t if r == "assistant" else "") for r, t in turns]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 0, None, "x\\y"), (3, 5, "user", "b"), (3, 5, "user", "a"), (3, 5, "user", "a"), (None, None, "assistant", "é")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id bigint, turn int, role string, text string, conv string")
    got = {r.conv_id: r for r in conversation_digest(df).collect()}
    whole = {r.conv_id: r for r in format_conversations(df).collect()}
    order = {1: [0, 1], 2: [3, 2], 3: [5, 6, 4], None: [7]}
    for c, at in order.items():
        turns = "".join(f"{rows[i][2] or ''}\n{rows[i][3] or ''}\n" for i in at)
        loss = "".join(rows[i][3] or "" for i in at if rows[i][2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(at), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[c].formatted
        assert got[c].formatted_chars == len(text) and unescape("".join(text[s.start : s.end] for s in whole[c].generated)) == loss
    assert conversation_digest(df.limit(0)).count() == 0


def test_language():
    run = lambda s, **v: "".join(t for t, _ in compiled(s)(**v))
    assert run("{% for x in xs %}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{{ x }}{{ loop.index }}{% endfor %}", xs=["a", "b", "c"]) == "<a1-b2>c3"
    assert run("{{ a['k'] | upper ~ 1 + 2 }}{# no #}{{ a.none }}{{ not (1 == 2) and 'x' in 'xy' }}", a={"k": "v"}) == "V12true"
    assert fold(parse("{{ 'a' + 'b' }}{% if 1 > 2 %}no{% else %}c{% endif %}{{ 'd' | upper }}")) == Node("block", (Node("text", ("abcD",)),))
    assert list(compiled("{% generation %}{{ x }}{% endgeneration %}!")(x="y")) == [("y", True), ("!", False)]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ _x }}", "{% for a %}", "{{ a | eval }}", "{% if a %}", "{{ a + }}", "{{ 'a }}", "{% import os %}", "{{ a() }}", "{{ " + "(" * 400 + "1" + ")" * 400 + " }}"])
def test_what_templates_may_not(bad):
    with pytest.raises(TemplateError):
        compiled(bad)


def test_only_keys_are_reached():
    with pytest.raises(TemplateError):
        list(compiled("{{ x.real }}")(x=1.5))
