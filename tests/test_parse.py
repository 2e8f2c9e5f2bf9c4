import hashlib
import time

import pytest

from quillspark.operators.contract import ContractError, fields, source_path, split, validate
from quillspark.operators.documents import parse, parse_file, tables_of
from quillspark.operators.markdown import parse_body

GOOD = "---\ntitle: T\nsource: s\ningested_at: 2026-01-01\ndoc_type: page\nsource_path: a/b.md\n{}---\n{}"


@pytest.mark.parametrize(
    "body, chunks",
    [
        ("intro\n\n## A\n\nx", [([], "intro"), (["A"], "## A\nx")]),
        ("# T\n\n## A\n\n### B\n\n#### C", [(["T"], "# T"), (["T", "A"], "## A"), (["T", "A", "B"], "### B\n#### C")]),
        ("## A\n\n## B\n\n## C", [(["A"], "## A"), (["A", "B"], "## B"), (["A", "C"], "## C")]),
        ("# [T](u.md)", [([], "[T](u.md)"), (["T"], "# T")]),
        ("See [B](b.md#s).", [([], "[B](b.md#s)\nSee B.")]),
        ("- a\n- b", []),
        ("one\ntwo", [([], "onetwo")]),
        ("", []),
        ("Setext\n===\n\ntext", [(["Setext"], "# Setext\ntext")]),
        ("> quoted *words*", [([], "quoted words")]),
        ("- a\n\n- b", [([], "a\nb")]),
        ("| a |\n|---|\n| b |\n\nend", [([], "end")]),
        ("<div>\nraw\n</div>\n\nend", [([], "end")]),
        ("# A\r\n\r\nx\r\n", [(["A"], "# A\nx")]),
    ],
)
def test_chunks(body, chunks):
    assert [(c["heading_hierarchy"], c["content"]) for c in parse_body(body, "s", "p")[0]] == chunks


def test_offsets_are_bytes_and_ids_are_hashes():
    chunks = parse_body("é\n\n## A", "s", "p")[0]
    assert [c["char_offset"] for c in chunks] == [0, 3] and [c["position"] for c in chunks] == [0, 1]
    assert chunks[0]["chunk_id"] == hashlib.sha256("é\0s\0p".encode()).hexdigest()


def test_links_and_code():
    _, links, code, title = parse_body("# T\n\n[a](x.md#y) and `[c](d.md)` <http://e.f>\n\n```rust\n```\n\n    indented\n\n[r][1]\n\n[1]: /abs", "s", "p")
    assert {(x["target_path"], x["link_text"], x["anchor"]) for x in links} == {("x.md", "a", "y"), ("http://e.f", "http://e.f", None), ("/abs", "r", None), ("d.md", "c", None)}
    assert [(c["language"], c["content"]) for c in code] == [("rust", ""), (None, "indented")]
    assert title == "T"


def test_frontmatter():
    assert split("---\na: 1\n---\nbody") == ("a: 1", "body")
    assert split("---\r\na: 1\r\n...\r\nbody") == ("a: 1", "body")
    assert split("---\na: 1\n---x\ny") == ("a: 1", "x\ny")
    assert split("---\nnever closed") == (None, "---\nnever closed")
    assert split(" ---\na: 1\n---\n")[0] is None
    assert fields("a: 2024-01-01\nb: 1.0\nc: ~") == {"a": "2024-01-01", "b": "1.0", "c": None}


@pytest.mark.parametrize("path", ["", "/a", "C:/a", "a/../b", "./a", "a//b", "a/"])
def test_bad_paths(path):
    with pytest.raises(ContractError) as e:
        source_path(path)
    assert e.value.field == "source_path"


def test_contract():
    front, body = split(GOOD.format("canonical_url: '  '\n", "x"))
    assert validate(front, body).canonical_url is None and validate(front, body).schema_version == "1.0"
    with pytest.raises(ContractError, match="schema_version"):
        validate(front + "\nschema_version: 2.0", body)
    with pytest.raises(ContractError, match="content_sha256"):
        validate(front + "\ncontent_sha256: 00", body)
    digest = hashlib.sha256(b"a\nb").hexdigest().upper()
    assert validate(front + f"\ncontent_sha256: {digest}", "a\r\nb").content_sha256 == digest
    for name in ("title", "source", "ingested_at", "doc_type"):
        with pytest.raises(ContractError) as e:
            validate("\n".join(x for x in front.split("\n") if not x.startswith(f"{name}:")), body)
        assert e.value.field == name
    assert parse_file(b"\xff", "s", "f")["error"].startswith("not UTF-8")
    assert parse_file(b"no front", "s", "f")["error"] == "no frontmatter"


def test_tables(spark):
    raw = GOOD.format("canonical_url: /u\n", "# A\n\n[x](y.md)\n\n```py\nz\n```").encode()
    files = spark.createDataFrame([("s", "f.md", bytearray(raw)), ("s", "bad.md", bytearray(b"x"))], "source_id string, fs_rel string, raw binary")
    tables = {n: t.collect() for n, t in tables_of(parse(files)).items()}
    assert [len(tables[n]) for n in ("chunks", "edges", "code", "urls")] == [1, 1, 1, 1]
    assert tables["urls"][0]["chunk_id"] == tables["chunks"][0]["chunk_id"] and tables["chunks"][0]["title"] is None


HOSTILE = {
    "open brackets": "[" * 10**6, "quotes": ">" * 10**6, "stars": "*" * 10**6, "emphasis": "*a" * 500_000, "ticks": "`a``b" * 200_000, "angles": "<" * 10**6,
    "nested brackets": "[" * 500_000 + "]" * 500_000, "open links": "[a]( x " * 140_000, "images": "![a" * 100_000 + "](x)" * 100_000, "blanks": "# " + " " * 10**6 + "x",
    "items": "- " * 500_000 + "x", "blank lines": "- a\n" + "\n" * 10**6 + "b", "parentheses": "(" * 10**6, "names": "[x]: y\n" * 100_000 + "[x] " * 100_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(name):
    """A megabyte of marks costs at most a few times what a tenth of it costs, and is a document or an error row."""
    text, took = GOOD.format("", HOSTILE[name]), []
    halves = {"images": ("![a", "](x)"), "names": ("[x]: y\n", "[x] ")}  # a tenth of these texts is a tenth of both halves
    tenth = GOOD.format("", "".join(h * 10_000 for h in halves[name])) if name in halves else text[: len(text) // 10]
    for part in (tenth, text):
        began = time.process_time()
        row = parse_file(part.encode(), "s", "f")
        took.append(time.process_time() - began)
    assert row["path"] == "a/b.md" and row["error"] is None and took[1] < 25 * max(took[0], 0.2)


def test_any_fault_costs_its_file_only(spark):
    bad = {"version.md": GOOD.format("schema_version: ²\n", "x"), "deep.md": GOOD.format("", ">" * 1500), "yaml.md": "---\n" + "[" * 5000 + "\n---\nx", "good.md": GOOD.format("", "# A")}
    files = spark.createDataFrame([("s", n, bytearray(t.encode())) for n, t in bad.items()], "source_id string, fs_rel string, raw binary")
    rows = {r["fs_rel"]: r for r in parse(files).collect()}
    assert len(rows) == 4 and [n for n in rows if rows[n]["error"] is None] == ["good.md"] and rows["version.md"]["error_field"] == "schema_version"
    assert all(r["chunks"] == [] for n, r in rows.items() if n != "good.md")


def test_rows_leave_a_task_in_small_pieces():
    """However many files a batch has, only those of about a megabyte are held; what is left out stays in the task."""
    import pyarrow as pa

    from quillspark.operators import documents

    raw = [GOOD.format("", "# T\n\n" + "word " * 20_000 + "[a](x.md)").encode() for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"source_id": ["s"] * 60, "fs_rel": [f"{k}.md" for k in range(60)], "raw": raw})
    found = list(documents._parse(True, ("links",))(iter([batch])))
    assert sum(b.num_rows for b in found) == 60 and max(b.num_rows for b in found) <= 11
    assert all(r["chunks"] == [] and len(r["links"]) == 1 and r["error"] is None for b in found for r in b.to_pylist())


def test_easy_texts_read_as_others_do(monkeypatch):
    import random
    import re

    from quillspark.operators import markdown

    rng = random.Random(5)
    marks = ["\\", "\\", "a", "é", " ", "\n", "!", "(", ")", "]", "[", "<", "`", "*", "_", "~", "&", "&amp;", ".", "#", ">", "|", "-", "    ", "\t", "~~~\n", "```\n", "[a](b)", "\n\n", "## x\n"]
    texts = ["".join(rng.choice(marks if k % 2 else marks[:9]) for _ in range(rng.randrange(30))) for k in range(4000)]
    fast = [parse_body(t, "s", "p") for t in texts]
    monkeypatch.setattr(markdown, "_EASY", re.compile(r"(?!)"))
    monkeypatch.setattr(markdown, "_LINK_OR_CODE", re.compile(""))
    assert fast == [parse_body(t, "s", "p") for t in texts]


def test_permissive(spark):
    files = spark.createDataFrame([("s", "x/y.md", bytearray(b"# First\n\ntext")), ("s", "z.md", bytearray(b"---\ntitle: T\n---\n# A"))], "source_id string, fs_rel string, raw binary")
    rows = {r["path"]: r for r in parse(files, contract=False).collect()}
    assert {p: (r["title"], r["error"], len(r["chunks"])) for p, r in rows.items()} == {"x/y.md": ("First", None, 1), "z.md": ("T", None, 1)}


def test_what_is_nested_too_deeply_is_text():
    deep = "".join("> " * 150 + f"line {k} [a](x.md)\n" for k in range(3))
    chunks, links, _, _ = parse_body("# T\n\n" + deep + "\n\nafter", "s", "p.md")
    assert "line 0 a" in chunks[0]["content"].replace("> ", "") and chunks[0]["content"].endswith("after") and len(links) == 3
    images = "![a" * 9 + "](x)" * 9
    assert "a" in parse_body(images, "s", "p.md")[0][0]["content"]
