"""Revisions of made-up statutes against a walk through their paragraphs in plain Python."""

import random
import re

from pyspark.sql import functions as F

from docloom.operators import revisions as R

DATE = r"\d{4}\s*(?:\.|년)\s*\d{1,2}\s*(?:\.|월)\s*\d{1,2}\s*(?:\.|일)?"


def iso(text):
    m = re.search(r"(\d{4})\s*(?:\.|년)\s*(\d{1,2})\s*(?:\.|월)\s*(\d{1,2})", text or "")
    return f"{m[1]}-{int(m[2]):02}-{int(m[3]):02}" if m and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 31 else None


def plain_revisions(blocks):
    """(pos, label, date, effective, deleted) of one statute's (pos, level, path, text) in order."""
    history, own, whole, addenda, article, addendum, seen = [], {}, {}, [], None, None, False
    for pos, level, path, text in blocks:
        text = re.sub("<[A-Za-z/][^>]*>", " ", text or "")
        seen |= level == 5
        if not seen:
            history += [(iso(d), re.sub(r"\s", "", k)) for k, d in re.findall(rf"(제\s*정|전\s*면\s*개\s*정|전\s*부\s*개\s*정|일\s*부\s*개\s*정|개\s*정)\s*({DATE})", text)]
            history += [(iso(d), k) for d, k in re.findall(rf"({DATE})\s*,\s*(제정|전부개정|전면개정|일부개정)\s*\]", text)]
        if level in (1, 2):
            article = addendum = None
            if head := re.match(r"부\s*칙(?=[\s(<\[]|$)", text.strip()):
                addendum = [text.strip()[head.end() :], []]
                addenda.append(addendum)
                continue
        if addendum:
            addendum[1].append(text)
            continue
        if level and level < 5:
            article = None
        elif level == 5:
            article = path
        if article is None:
            continue
        own[pos] = (article, [])
        for scope, action, dates in re.findall(rf"[(<\[]\s*(본조|전문|제목|조|항|호|목)?\s*(개정|신설|삭제)\s*((?:{DATE}\s*,?\s*)+)[)>\]]", text):
            kind = {("본조", "신설"): "신설", ("전문", "개정"): "전문개정"}.get((scope, action))
            for d in re.findall(DATE, dates):
                (whole.setdefault(article, []) if kind else own[pos][1]).append((iso(d), kind or action))
    history = [h for h in history if h[0]]
    base = max((h for h in history if h[1] in ("제정", "전면개정", "전부개정")), default=None)
    dates, taken, last, entries, paired = sorted({d for d, _ in history}), set(), None, [], {}
    proviso = re.compile(rf"다만\s*,?(.{{0,200}}?)({DATE})\s*(?:일)?\s*부터\s*시행", re.S)
    for head, body in addenda:
        body = "\n".join(body)
        other = {int(n): iso(m[2]) for m in proviso.finditer(body) for n in re.findall(r"제\s*(\d+)\s*조", m[1]) if iso(m[2])}
        main = proviso.sub(" ", body)
        m = re.search(rf"({DATE})\s*(?:일)?\s*부터\s*시행", main)
        revision, effective = iso(head), iso(m[1]) if m else None
        if revision is None and effective:
            revision = max((d for d in dates if d <= effective and d not in taken and (last is None or d > last)), default=None)
        if revision:
            taken.add(revision)
            last = revision
            if effective is None and re.search(r"(?:공포|발령)\s*(?:한\s*날|일)\s*부터\s*시행", main):
                effective = revision
        if effective:
            entries.append((effective, other))
            if revision:
                paired[revision] = entries[-1]
    out = {}
    for pos, (path, marks) in own.items():
        every = [x for x in marks + whole.get(path, []) if x[0]] + ([base] if base else [])
        if not every:
            continue
        date = max(d for d, _ in every)
        kinds = sorted({k for d, k in every if d == date})
        entry = paired.get(date) or min((e for e in entries if e[0] >= date), key=lambda e: e[0], default=entries[-1] if entries else None)
        number = re.match(r"제\s*(\d+)\s*조", path or "")
        effective = entry and (entry[1].get(int(number[1]), entry[0]) if number else entry[0])
        out[pos] = (next((k for k in kinds if k not in ("개정", "삭제")), "개정"), date, effective, date if "삭제" in kinds else None)
    return out


def statute(rng):
    day = lambda: rng.choice(["{}. {}. {}.", "{}년 {}월 {}일", "{}.{}.{}"]).format(rng.randint(2001, 2006), rng.choice([1, 2, 12, 13]), rng.choice([1, 9, 31]))
    blocks = [(None, None, rng.choice(["", f"제정 {day()}", f"제 정 {day()} 일부개정 {day()}", f"[시행 규칙, {day()}, 전부개정]", "no history"]))]
    for chapter in range(rng.randint(1, 2)):
        blocks.append((2, None, f"제{chapter + 1}장 총칙"))
        for n in range(rng.randint(0, 3)):
            name = f"제{n + 1}조(제목)"
            blocks.append((5, name, f"{name} 본문 {rng.choice(['', f'[본조신설 {day()}]', f'<개정 {day()}, {day()}>'])}"))
            for _ in range(rng.randint(0, 3)):
                blocks.append((rng.choice([None, 6]), None, rng.choice(["내용", f"내용 <개정 {day()}>", f"(항 삭제 {day()})", f"[전문개정 {day()}]", f'<table class="개정 2009. 1. 1."><td>a</td></table> [호 신설 {day()}]', f"<b><삭제 {day()}></b>"])))
    for _ in range(rng.randint(0, 3)):
        blocks.append((2, None, rng.choice(["부칙", f"부 칙 <{day()}>", "부칙 (제2호)"])))
        blocks.append((5, "제1조(시행일)", rng.choice([f"이 규정은 {day()}부터 시행한다.", "이 규정은 공포한 날부터 시행한다.", f"이 규정은 {day()}부터 시행한다. 다만, 제2조 및 제3조는 {day()}부터 시행한다.", "경과조치"])))
    return [(i, *b) for i, b in enumerate(blocks)]


def test_revisions_equal_a_plain_walk(spark):
    rng = random.Random(21)
    docs = {d: statute(rng) for d in [*range(150), None]}
    rows = [(d, *b, "clash", "x") for d, blocks in docs.items() for b in blocks]
    table = spark.createDataFrame(rows, "doc int, pos int, level int, path string, text string, date string, article2 string").repartition(5)
    got = R.annotate_revisions(table, "doc", "pos").collect()
    assert len(got) == len(rows) and got[0].__fields__ == [*table.columns, "revision"]
    want = {(d, pos): r for d, blocks in docs.items() for pos, r in plain_revisions(blocks).items()}
    assert {(r.doc, r.pos): tuple(r.revision) for r in got if r.revision} == want
    assert len(want) > 300 and {r[0] for r in want.values()} >= {"개정", "신설", "전문개정", "제정"} and any(r[3] for r in want.values())
    assert R.annotate_revisions(table.limit(0), "doc", "pos").count() == 0


def test_fields_and_stamp(spark):
    rows = [("본문", ("개정", "2026-04-30", "2026-05-01", None)), ("본문", ("개정", "2026-04-30", None, "2026-04-30")), ("본문", None)]
    table = spark.createDataFrame(rows, "text string, revision struct<label:string,date:string,effective:string,deleted:string>")
    got = [tuple(r) for r in table.select(*R.revision_fields(F.col("revision")), R.stamp(F.col("text"), F.col("revision"))).collect()]
    assert got == [
        ("2026년 4월 30일", "2026년 5월 1일", "", "본문\n\n(개정일 2026년 4월 30일, 시행일 2026년 5월 1일)"),
        ("2026년 4월 30일", None, "2026년 4월 30일", "본문\n\n(개정일 2026년 4월 30일)"),
        (None, None, None, "본문"),
    ]


def test_versions_do_not_overlap(spark):
    rows = [("a", "2020-01-01", "제정"), ("a", "2021-01-01", "개정"), ("a", "2021-01-01", "개정"), ("a", "2022-01-01", "삭제"), ("a", "2022-01-01", "전문개정"), ("a", "2023-01-01", "신설"), ("a", None, "개정"), (None, "2020-01-01", "개정"), ("b", "2020-01-01", None)]
    got = {(r.key, r.valid_from): (r.label, r.valid_to) for r in R.versions(spark.createDataFrame(rows, "key string, day string, kind string"), "key", "day", "kind").collect()}
    assert got == {
        ("a", "2020-01-01"): ("제정", "2021-01-01"), ("a", "2021-01-01"): ("개정", "2022-01-01"), ("a", "2022-01-01"): ("전문개정", "2022-01-01"), ("a", "2023-01-01"): ("신설", None),
        (None, "2020-01-01"): ("개정", None), ("b", "2020-01-01"): ("개정", None),
    }


def test_addenda_of_whole_numbers(spark):
    addenda = spark.createDataFrame([(1, 0, None, -5), (1, 1, None, 7), (1, 2, 3, None)], "k int, i int, date long, effective long")
    revisions = spark.createDataFrame([(1, -9), (1, 6), (1, 2), (2, 1)], "k int, date long")
    assert sorted((r.i, r.revision) for r in R.pair_addenda(addenda, revisions, "k").collect()) == [(0, -9), (1, 6), (2, 3)]
