"""Chunkers against plain models written from their rules, and the literals they must meet."""

import re

import pytest
from conftest import SMALL
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import chunkers
from millrace.operators.registry import get


def chunked(spark, name, texts, **params):
    """The chunks of each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = get("chunker", name)(df, **params).orderBy("doc_id", "chunk_index").collect()
    out = [[] for _ in texts]
    for r in rows:
        assert r["chunk_index"] == len(out[r["doc_id"]])
        out[r["doc_id"]].append((r["text"], r["meta"]))
    assert all(r["total_chunks"] == len(out[r["doc_id"]]) for r in rows)
    return out


def texts_of(found):
    return [[t for t, _ in x] for x in found]


# ---- models: strings all the way, one character or piece at a time

def model_recursive(text, size, overlap, separators):
    def cut(x, depth):
        if depth and len(x) <= size:
            return [x]
        if depth == len(separators):
            return [x[i : i + size] for i in range(0, len(x), size)]
        sep = separators[depth]
        if sep == "":
            return list(x)
        parts = re.findall(f"(?s).*?{re.escape(sep)}|.+$", x)
        return [y for p in parts for y in cut(p, depth + 1)]

    done, now = [], ""
    for part in cut(text, 0) if text else []:
        if len(now + part) > size:
            done += [now] if now else []
            tail = done[-1][-overlap:] if done and overlap else ""
            now = tail if len(tail + part) <= size else ""
            if len(part) > size:
                done.append(part)
                part = ""
        now += part
    return [x for x in [*done, now] if x.strip()]


def model_section(section, size, overlap):
    """A long section by paragraphs."""
    done, now = [], None
    for para in section.split("\n\n"):
        if now is not None and len(now) + 2 + len(para) <= size:
            now += "\n\n" + para
            continue
        if now:
            done.append(now)
        if now is None and len(para) + 2 <= size:
            now = para or None
            continue
        tail = done[-1][-overlap:] + "\n\n" if done and overlap else ""
        now = tail + para if len(tail + para) <= size else para
        if len(now) > size:
            while now:
                done.append(now[:size])
                now = now[size - overlap :]
            now = None
    return [*done, now] if now else done


def model_markdown(text, size, overlap):
    out, lines, heads = [], [], {}

    def close():
        section = "\n".join(lines)
        parts = [section] if len(section) <= size else model_section(section, size, overlap)
        out.extend((p, dict(heads)) for p in parts if p.strip())

    for line in text.split("\n"):
        marks = re.match(r"^(#+)(?=\s|$)", line.strip())
        if marks and len(marks[1]) <= 4:
            close()
            lines.clear()
            level = len(marks[1])
            for k in [k for k in heads if int(k[1]) >= level]:
                del heads[k]
            heads[f"h{level}"] = line.strip()[level:].strip()
        lines.append(line)
    close()
    return out


def model_sections(text, size, overlap):
    out, name, body = [], "ROOT", []

    def close():
        s, at = "\n".join(body).strip(), 0
        while at < len(s):
            out.append((s[at : at + size], name))
            if at + size >= len(s):
                return
            at += size - overlap

    for line in text.split("\n"):
        if re.fullmatch(r"#{1,6} .+", line):
            close()
            name, body = line.lstrip("#").strip(), []
        else:
            body.append(line)
    close()
    return out


def model_parents(text, parent_size, child_size):
    def pack(x, sep, size):
        done, now = [], ""
        for part in [p.strip() for p in x.split(sep) if p.strip()]:
            if now and len(now + sep + part) <= size:
                now += sep + part
                continue
            done += [now] if now else []
            now = part
            if len(part) > size:
                done += [part[i : i + size] for i in range(0, len(part), size)]
                now = ""
        return ([*done, now] if now else done) or [x[:size]]

    out = []
    for i, parent in enumerate(pack(text, "\n\n", parent_size) if text else []):
        out.append((parent, f"p_{i}", None))
        out += [(c, None, f"p_{i}") for c in pack(parent, "\n", child_size)]
    return out


def model_sentences(text, most, overlap):
    units = []
    for s in re.split(r"(?<=[.!?。！？])\s+|\n+", text):
        w = s.split()
        units += [w[i : i + most] for i in range(0, len(w), most)]
    out, now = [], []
    words = lambda us: [w for u in us for w in u]
    for u in units:
        if now and len(words([*now, u])) > most:
            out.append(" ".join(words(now)))
            while now and (len(words(now)) > overlap or len(words([*now, u])) > most):
                now = now[1:]
        now.append(u)
    return [*out, " ".join(words(now))] if now else out


TEXT = st.lists(st.sampled_from(["\n\n", "\n", " ", "# A\n", "\n## B c\n", "\n#\n", "\n##### e\n", "a", "bb", "ccc dd", "eeee. ", "段落。", "!x? ", "f" * 9]), max_size=40).map("".join)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])
@given(st.lists(TEXT, min_size=30, max_size=30), st.sampled_from([(12, 4), (20, 0), (9, 8)]))
def test_chunkers_equal_their_models(spark, texts, sizes):
    size, overlap = sizes
    assert texts_of(chunked(spark, "recursive", texts, chunk_size=size, overlap=overlap)) == [model_recursive(t, size, overlap, ("\n\n", "\n", " ", "")) for t in texts]
    assert chunked(spark, "markdown", texts, chunk_size=size, overlap=overlap) == [model_markdown(t, size, overlap) if t else [] for t in texts]
    assert [[(t, m["heading"]) for t, m in x] for x in chunked(spark, "markdown_section", texts, chunk_size=size, overlap=overlap)] == [model_sections(t, size, overlap) for t in texts]
    assert [[(t, m.get("chunk_id"), m.get("parent_id")) for t, m in x] for x in chunked(spark, "parent_child", texts, parent_max_chars=size, child_max_chars=overlap + 1)] == [model_parents(t, size, overlap + 1) for t in texts]
    assert texts_of(chunked(spark, "llama_sentence", texts, max_tokens=6, overlap=2)) == [model_sentences(t, 6, 2) for t in texts]


def test_whole_documents_equal_their_models(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text")).collect()
    texts = ["# Title\n" + (r["text"] or "") for r in docs]
    assert texts_of(chunked(spark, "recursive", texts)) == [model_recursive(t, 1024, 256, ("\n\n", "\n", " ", "")) for t in texts]
    assert chunked(spark, "markdown", texts) == [model_markdown(t, 1024, 256) for t in texts]


# ---- fixed literals

def test_literals(spark):
    assert len(chunked(spark, "simple", ["第一段内容。\n\n第二段内容。\n\n第三段内容。"])[0]) == 3
    assert texts_of(chunked(spark, "simple", ["段落A|||段落B|||段落C"], separator="|||")) == [["段落A", "段落B", "段落C"]]
    long = texts_of(chunked(spark, "simple", ["一二三四五六七八九十" * 3], max_chars=10))[0]
    assert len(long) > 1 and all(len(c) <= 10 for c in long)
    assert len(chunked(spark, "simple", [""])[0]) == 1 and chunked(spark, "sliding_window", [""]) == [[]]
    first, second, *_ = texts_of(chunked(spark, "sliding_window", ["ABCDEFGHIJKLMNOPQRST"], window=10, overlap=5))[0]
    assert second.startswith(first[-5:])
    assert "".join(texts_of(chunked(spark, "sliding_window", ["ABCDEFGHIJ"], window=5, overlap=0))[0]) == "ABCDEFGHIJ"
    assert all(len(c) <= 70 for c in texts_of(chunked(spark, "recursive", ["One sentence. " * 30], chunk_size=50, overlap=10))[0])
    for name in ("simple", "sliding_window", "recursive"):
        assert all(chunked(spark, name, ["中文段落\n\n日本語の段落", "한국어 단락", "emoji 🎉🎊"]))
    with pytest.raises(ValueError):
        chunked(spark, "recursive", ["x"], chunk_size=10, overlap=10)


PYTHON = '''import os
from re import sub


def first(a):
    return a


@wraps
async def second():
    pass


class Third:
    x = 1
'''
SCRIPT = '''import a from "a";
function one() { return {}; }
const two = () => {
  return 1;
};
class Three { m() { } }
'''


def test_code(spark):
    blocks = [(m["block_type"], m.get("name"), m["line_start"], m["line_end"]) for _, m in chunked(spark, "code", [PYTHON])[0]]
    assert blocks == [("import", None, "1", "2"), ("function", "first", "5", "6"), ("function", "second", "10", "11"), ("class", "Third", "14", "15")]
    texts = texts_of(chunked(spark, "code", [PYTHON]))[0]
    assert texts[0] == "import os\nfrom re import sub" and texts[1] == texts[0] + "\n\ndef first(a):\n    return a"
    found = chunked(spark, "code", [SCRIPT, "", "no code at all"])
    assert [m.get("name") for _, m in found[0]] == [None, "one", "two", "Three"] and found[0][1][0].endswith("function one() { return {}; }")
    assert found[1] == [] and [m["block_type"] for _, m in found[2]] == ["other"]
    parts = chunked(spark, "code", [PYTHON.replace("return a", "a = 1\n    " * 50 + "return a")], max_chunk_size=200)[0]
    assert [m["name"] for _, m in parts if m["block_type"] == "function"][:3] == ["first_part1", "first_part2", "first_part3"]
    for lang, x in (("java", "import a.b;\npublic class A { int f() { return 1; } }"), ("go", "package p\nimport \"x\"\nfunc F() { if x { } }\ntype T struct { }"), ("rust", "use a;\nfn f() { let mut x = 1; }\nstruct S { a: u8 }")):
        kinds = [m["block_type"] for _, m in chunked(spark, "code", [x])[0]]
        assert kinds[0] == "import" and len(kinds) >= 2 and {m["language"] for _, m in chunked(spark, "code", [x])[0]} == {lang}


def test_whole_document_parents_are_whole(spark):
    text = "x" * 50_000
    whole = lambda **p: texts_of(chunked(spark, "parent_child", [text], parent_mode="full_doc", **p))[0][0]
    assert whole() == text and len(whole(full_doc_chars=40_000)) == 40_000


def test_texts_are_split_once_a_row(spark):
    """The time of token windows is linear in a text's length."""
    df = spark.createDataFrame([(1, "word " * 10)], "doc_id long, text string")
    plan = chunkers.token_window(df, 4, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
