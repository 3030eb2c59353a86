"""Numerals, references and citations against plain forms written from their rules."""

import random
import re

import pytest
from folio.functions import citations, numerals, references
from pyspark.sql import functions as F

UNIT = {"十": 10, "百": 100, "千": 1000}
KANJI = "〇一二三四五六七八九"


def loop(s, run, kinds):
    """Total of units; run: digits in a row run on."""
    total = now = 0
    for ch in s:
        if ch in UNIT:
            total, now = total + (now or 1) * UNIT[ch], 0
        elif ch in kinds:
            d = kinds.index(ch) % 10
            now = now * 10 + d if run else d
    return total + now


def segment(s):
    return loop(s, True, KANJI) if s and all(ch in KANJI or ch in UNIT for ch in s) else None


def reader(s):
    if s is None:
        return None
    s = s.translate({ord("０") + i: str(i) for i in range(10)})
    digit = dict(zip("零" + KANJI, "00123456789"))
    s = re.sub("([〇零一二三四五六七八九]*)[・.]([〇零一二三四五六七八九]+)", lambda m: f"{digit[m[1]] if len(m[1]) == 1 else '0'}.{''.join(digit[x] for x in m[2])}", s)

    def value(x):
        if not re.search("[一二三四五六七八九十百千]", x):
            m = re.match(r"\s*([+-]?[0-9]+)", x)
            return int(m[1]) if m else 0
        if re.fullmatch("[0-9零〇一二三四五六七八九]+", x):
            return int("".join(digit.get(ch, ch) for ch in x))
        return loop(x, False, "-一二三四五六七八九0123456789")

    if not re.search("[一二三四五六七八九十百千万]", s):
        return s
    parts = s.split("万")
    return str(value(parts[0] or "一") * 10000 + value(parts[1]) if len(parts) == 2 else value(s))


def cases(seed, n=400):
    r = random.Random(seed)
    return [None, "", "万", "一万", "十万", "万五", "億", "一億", "二五十", "〇・七五", "一二・五", "十", "百", "二百一", "一〇", "第五条", "０３", "3万2", "12abc", "万万", "五万万", "x"] + ["".join(r.choice("〇零一二三五九十百千万3０・.x億") for _ in range(r.randint(1, 7))) for _ in range(n)]


def test_two_rules_for_numerals(spark):
    rows = cases(1)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    found = {r.i: r for r in df.select("i", numerals.reader_number(F.col("s")).alias("a"), numerals.segment_number(F.col("s")).alias("b")).collect()}
    bad = [(s, found[i].a, reader(s)) for i, s in enumerate(rows) if found[i].a != reader(s)]
    assert not bad
    assert not [(s, found[i].b, segment(s)) for i, s in enumerate(rows) if found[i].b != segment(s)]
    by = {s: found[i] for i, s in enumerate(rows)}
    assert by["万"].a == "10000" and by["一億"].a == "1" and by["億"].a == "億" and by["二五十"].b == 250 and by["一万"].b is None and by["二五十"].a == "50"
    keys = spark.createDataFrame([("十二の三",), ("一の",), ("二",), (None,)], "s string").select(numerals.segment_key(F.col("s"))).collect()
    assert [r[0] for r in keys] == ["12-3", None, "2", None]


NUM = "(?:[一二三四五六七八九十百千]+|[0-9]+|[０-９]+)"
KINDS = [(f"法第{NUM}条(?:の{NUM})*", "act", "article"), (f"令第{NUM}条(?:の{NUM})*", "order", "article"), (f"別表第{NUM}", "same", "appendix"), (f"付表第{NUM}", "same", "appendix"), (f"(?<![法令])第{NUM}条(?:の{NUM})*", "same", "article")]


def detected(text):
    """Kinds in order of priority, none where an earlier one has claimed a character."""
    claimed, out = set(), []
    for form, law, level in KINDS:
        for m in re.finditer(form, text or ""):
            if claimed.isdisjoint(range(*m.span())):
                claimed.update(range(*m.span()))
                number = re.sub("^(?:[法令]|別表|付表)?第", "", m[0]).replace("条", "")
                out.append((*m.span(), m[0], "の".join(reader(x) for x in number.split("の")), law, level))
    return sorted(out)


def test_references(spark):
    r = random.Random(2)
    rows = [None, "", "第二条の三の四", "法第二条第一項第三号", "別表第二条", "法令第三条", "施行令第五条の2", "𠮷第三条"] + ["".join(r.choice(["法", "令", "第", "条", "の", "別表", "付表", "二", "十", "3", "４", "項", "第二条", "x"]) for _ in range(r.randint(1, 14))) for _ in range(500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "id int, text string")
    found = {}
    for x in references.detected(df).collect():
        found.setdefault(x.id, []).append(tuple(x)[1:])
    assert {i: sorted(found.get(i, [])) for i in range(len(rows))} == {i: detected(s) for i, s in enumerate(rows)}
    assert found[2] == [(0, 7, "第二条の三の四", "2の3の4", "same", "article")] and found[3][0][:3] == (0, 4, "法第二条")


def number(s):
    return int(s) if re.fullmatch("[0-9]+", s) else loop(s, False, KANJI)


def path_of(a, b, p, i):
    base = f"art{number(a)}" + (f"-{number(b)}" if b else "")
    if i and not p:
        return f"{base}/para1/item{number(i)}", [f"{base}/item{number(i)}"]
    return base + (f"/para{number(p)}" if p else "") + (f"/item{number(i)}" if i else ""), [] if p else [f"{base}/para1"]


def relative(word, here):
    m = re.match("art([0-9]+)", here or "")
    if not m:
        return None
    a, p = int(m[1]), re.search("para([0-9]+)", here)
    simple = {"前条": a - 1, "次条": a + 1, "同条": a, "本条": a}
    if word in simple:
        return f"art{simple[word]}"
    if word in ("前項", "次項"):
        return p and f"art{a}/para{int(p[1]) + (1 if word == '次項' else -1)}"
    return here if word == "同項" else None


def resolved(text, law, here, names):
    named, n = [], 0
    if names is None:
        named = [(m.end(), m[1]) for m in re.finditer("([^\\s、。（）「」]{2,30}?(?:法|法律|政令|省令|規則|条例))(?:（[^）]*）)?", text)]
    while names is not None and n < len(text):
        own = max((x for x in names if text.startswith(x, n)), key=len, default=None)
        if own:
            n += len(own)
            aside = re.match("（[^）]*）", text[n:])
            named.append((n + (aside.end() if aside else 0), names[own]))
        else:
            n += 1
    out, N = [], "(?:[〇一二三四五六七八九十百千]+|[0-9]+)"
    for m in re.finditer(f"第({N})条(?:の({N}))?(?:第({N})項)?(?:第({N})号)?", text):
        close = [x for end, x in named if end <= m.start() and m.start() - end <= 40]
        short = next((a for a in ("法", "令", "規則", "この法律", "この政令", "この省令") if text[: m.start()].endswith(a)), None)
        path, other = path_of(*m.groups())
        whose, method, trust = (close[-1], "EXPLICIT", 0.95) if close else (f"@{short}", "ABBREVIATED", 0.8) if short else (law, "EXPLICIT", 0.7)
        out.append((*m.span(), m[0], whose, path, other, method, trust))
    for m in re.finditer("前条|次条|同条|本条|前項|次項|同項|前号|次号|同号|前二項|前三項|前各項|前各号", text):
        out.append((*m.span(), m[0], law, relative(m[0], here), [], "RELATIVE", 0.75 if here is not None else 0.3))
    for m in re.finditer(f"(明治|大正|昭和|平成|令和)({N})年(建設省|国土交通省|運輸省)告示第({N})号", text):
        out.append((*m.span(), m[0], f"{m[1]}{number(m[2])}年{m[3]}告示第{number(m[4])}号", None, [], "EXPLICIT", 0.9))
    return sorted(out, key=lambda x: x[0])


NAMES = {"甲法": "a", "甲法施行令": "o", "乙規則": "r", "乙": "b", "大甲法": "big"}
PIECES = ["甲法", "甲法施行令", "大甲法", "乙規則", "乙", "（昭和二十五年法律第二百一号）", "（未完", "第三条", "第十二条の2", "第二項", "第四号", "第五条第六号", "前条", "同条", "次項", "前二項", "法", "令", "規則", "この法律", "この政令", "平成十二年建設省告示第千四百号", "、", "及び", "文" * 20, "文" * 41, "第", "条"]


@pytest.mark.parametrize("names", [NAMES, None, {}])
def test_resolved_citations(spark, names):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(PIECES) for _ in range(r.randint(1, 9))), r.choice(["own", None]), r.choice(["art7/para3/item2", "art52-2", "suppl1", None])) for i in range(400)] + [(1000, None, "own", None), (1001, "", None, None)]
    df = spark.createDataFrame(rows, "id int, text string, law string, here string")
    known = None if names is None else spark.createDataFrame(list(names.items()), "name string, id string")
    found = {}
    for x in citations.resolved(df, known).collect():
        found.setdefault(x.id, []).append(tuple(x)[1:])
    for i, text, law, here in rows:
        assert found.get(i, []) == resolved(text or "", law, here, names), text


def test_names_within_names_and_far_names(spark):
    df = spark.createDataFrame([(1, "甲法施行令（昭和）第二条" + "文" * 38 + "第三条" + "文" * 41 + "第四条、大甲法第五条", "own", None)], "id int, text string, law string, here string")
    found = citations.resolved(df, spark.createDataFrame(list(NAMES.items()), "name string, id string")).collect()
    assert [(x.raw, x.law) for x in found] == [("第二条", "o"), ("第三条", "own"), ("第四条", "own"), ("第五条", "big")]


def test_links(spark):
    rows = [
        ("1", "L", None, "article", "1", 1, "前条、甲法第2条第三項及び 第二項と同条、別表第四"), ("2", "L", None, "article", "2", 2, "前条第二項 第一項第二号"), ("1/2", "L", "1", "paragraph", "2", 1, "同条 第二項"),
        ("x", "a", None, "article", "2", 1, None), ("x/3", "a", "x", "paragraph", "3", 1, "前条甲法施行令の第二条"),
    ]
    df = spark.createDataFrame(rows, "id string, law string, parent string, level string, number string, place long, text string")
    names = spark.createDataFrame(list(NAMES.items()), "name string, id string")
    found = {}
    for x in citations.linked(df, names).orderBy("id", "start").collect():
        found.setdefault(x.id, []).append((x.text, x.kind, x.target_law, x.number, x.target))
    assert found == {
        "1": [("前条", "previous", None, "前条", None), ("甲法第2条第三項", "law", "a", "2_3", "x/3"), ("第二項", "paragraph", None, "2", "1/2"), ("同条", "same", None, "同条", None), ("別表第四", "appendix", None, "4", None)],
        "2": [("前条第二項", "previous", None, "前条第二項", "1")], "1/2": [("同条", "same", None, "同条", "1"), ("第二項", "paragraph", None, "2", "1/2")],
        "x/3": [("前条", "previous", None, "前条", None), ("甲法施行令の第二条", "law", "o", "2", None)],
    }
