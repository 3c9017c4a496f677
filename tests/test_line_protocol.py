import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidegauge.sources.line_protocol import parse_line


def kinds(fields):
    return {k: (v["kind"], v["f"] if v["kind"] == "float" else v["i"] if v["kind"] == "integer" else v["b"] if v["kind"] == "boolean" else v["s"]) for k, v in fields.items()}


def test_shapes():
    name, tags, fields, t = parse_line("cpu,host=server01 value=1.5 1000000000")
    assert (name, tags, kinds(fields), t) == ("cpu", {"host": "server01"}, {"value": ("float", 1.5)}, 1_000_000_000)
    assert kinds(parse_line("m a=1024i,b=T,c=\"run, \\\"x\\\" = y\" 5")[2]) == {"a": ("integer", 1024), "b": ("boolean", True), "c": ("string", 'run, "x" = y')}
    assert parse_line("m a=1 1000", 1_000_000)[3] == 1_000_000_000
    assert parse_line("m a=1", now=77)[3] == 77
    assert parse_line("# note") is None and parse_line("  ") is None and parse_line("\r\n") is None
    assert parse_line("m a=1 5\r\n")[3] == 5


def test_escapes():
    name, tags, fields, _ = parse_line(r"my\ cpu,host\,x=a\=b,r=u\ s v\ 1=2 1")
    assert name == "my cpu" and tags == {"host,x": "a=b", "r": "u s"} and list(fields) == ["v 1"]
    assert parse_line("m,empty=,k=v a=1 1")[1] == {"k": "v"}
    assert parse_line('m tag="x",v=1 1')[:2] == ("m", {"tag": "x"})


@pytest.mark.parametrize("line", ["m", "m a", "m a= 1", "m a=abc 1", "m,k a=1 1", 'm a="x 1', "m a=99999999999999999999i 1", "m a=1 x", ",k=v a=1 1"])
def test_bad_lines(line):
    with pytest.raises(ValueError):
        parse_line(line, now=1)


@given(st.text(st.characters(blacklist_characters="\n\r\\", blacklist_categories=("Cs",)), min_size=1), st.text(st.characters(blacklist_characters="\n\r\\", blacklist_categories=("Cs",))))
def test_any_text_survives(key, text):
    import re

    esc = re.sub(r"([,= ])", r"\\\1", key)
    if key.strip(" ") != key or key.startswith("#") or key.startswith('"') or '"' in key:
        return
    quoted = '"' + re.sub(r'(["\\])', r"\\\1", text) + '"'
    name, tags, fields, _ = parse_line(f"m,k={esc} f={quoted} 1")
    assert tags == {"k": key} and fields["f"]["s"] == text


def test_plain_and_odd_lines_agree_with_the_parser(spark):
    """Whatever path a line takes, it gives what the parser of single lines gives."""
    from tidegauge.sources.line_protocol import _plain_points, parse_line, parsed

    lines = [
        "cpu,host=a value=1.5 1000000000", "cpu value=1", 'cpu,host=a,dc=x v=1i,w=-2.5e3,s="a \\"b\\" , c = d",t=true,u=F 77', 'm s="x 12"', 'm s="x 12" 13', "m v=.5,w=1.,x=+3 -5", "  m   v=1    9  ", "m v=1 9\r",
        "a\\ b,k\\,1=v\\=2 f\\ 1=1 5", 'm tag="x",v=1 5', "m,a=1,a=2 v=1 5", "m v=1,v=2 5", "m,a= v=1 5", "# no", "", "   ", "m", "m v=", "m v=abc 1", "m v=99999999999999999999i 1", "m v=1 99999999999999999999", 'm v="open 1', "m,a v=1 1", ",a=1 v=1 1",
        "m,h=é v=1,ü=2 3", "m v=1\t2", "m v=1 2 3", 'm s="\\\\" 4', 'm s="' + "x" * 5000 + '" 6', "m v=1e400 1", "m v=NaN 1", "m v=T,w=False 1", "m v=9223372036854775807i 8",
    ]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, line bigint")
    for multiplier, precision in ((1, "ns"), (1_000_000_000, "s")):
        got = {r.line: r for r in parsed(df, precision, 42).collect()}
        for i, x in enumerate(lines):
            try:
                want = parse_line(x, multiplier, 42)
            except ValueError:
                assert got[i].error, x
                continue
            if want is None:
                assert i not in got, x
                continue
            r = got[i]
            assert (r.measurement, r.tags, {k: v.asDict() for k, v in r.fields.items()}, r.time_ns, r.error) == (*want, None), x
    taken = {r.line for r in _plain_points(df, 1, 42).where("plain").collect()}
    assert {0, 1, 2, 3, 4, 5, 6, 7} <= taken
