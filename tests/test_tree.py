"""Source scan and function extraction on C text."""

import pytest
from pyspark.sql import functions as F

from threatloom.constants import TREE_SOURCE
from threatloom.operators.extract import all_functions
from threatloom.plans.corpus import dedup_snippets, tree_snippets
from threatloom.sources.labelled import with_text
from threatloom.sources.tree import read_sources, scan_tree

FILES = {
    "CWE121_Stack/s01/a_bad.c": b"""#include "x.h"
void CWE121_bad()
{
    char b[4];
    if (b) { b[9] = 0; }
}

static void goodG2B(int a,
    int b)
{
    use(a, b);
}
""",
    "CWE121_Stack/s01/b.cpp": b"char * goodSink(char *x) {\n    return x;\n}\n",
    "CWE78_OS/c.c": b'void bad_exec(void)\n{\n    puts("}");\n    system(x);\n}\n',
    "CWE999_Other/d.c": b"void other_bad()\n{\n}\n",
    "plain/e.c": b"void plain_bad()\n{\n}\n",
    "CWE121_Stack/f.c": b"int bad_proto(void);\nstatic int goodX() { return 1; }\nint goodBadMix(int n)\n{\n    if (n) {\n",
    "CWE121_Stack/g.c": b"void good\xff_x()\r\n{\r\n}\r\nvoid goodCr()\r\n{\r\n    f();\r\n}\r\n",
    "CWE121_Stack/h.h": b"void header_bad()\n{\n}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, content in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(base)


def test_scan_reads_only_the_two_suffixes(spark, root):
    rows = {r.rel_path: r for r in scan_tree(spark, root).collect()}
    assert set(rows) == {name for name in FILES if not name.endswith(".h")}
    assert rows["CWE121_Stack/s01/b.cpp"].language == "C++"
    assert rows["plain/e.c"].cwe_id == "UNKNOWN"
    assert "\r" not in rows["CWE121_Stack/g.c"].text
    assert "�" in rows["CWE121_Stack/g.c"].text


def test_labelled_functions(spark, root):
    rows = with_text(tree_snippets(scan_tree(spark, root))).collect()
    found = {(r.file_path, r.function_name): r for r in rows}
    assert set(found) == {
        ("CWE121_Stack/s01/a_bad.c", "CWE121_bad"),
        ("CWE121_Stack/s01/a_bad.c", "goodG2B"),
        ("CWE121_Stack/s01/b.cpp", "goodSink"),
        ("CWE78_OS/c.c", "bad_exec"),
        ("CWE121_Stack/f.c", "goodBadMix"),
        ("CWE121_Stack/g.c", "goodCr"),
    }
    first = found["CWE121_Stack/s01/a_bad.c", "CWE121_bad"]
    assert first.code_snippet == "void CWE121_bad()\n{\n    char b[4];\n    if (b) { b[9] = 0; }\n}"
    assert (first.label, first.cwe_id, first.language, first.source) == ("vulnerable", "CWE-121", "C", TREE_SOURCE)
    assert first.text == "CWE: CWE-121 | Language: C | Label: vulnerable\n\n" + first.code_snippet
    assert found["CWE121_Stack/s01/a_bad.c", "goodG2B"].label == "safe"
    # a brace in a string ends the span early; an unbalanced body leaves the header
    assert found["CWE78_OS/c.c", "bad_exec"].code_snippet == 'void bad_exec(void)\n{\n    puts("}'
    mixed = found["CWE121_Stack/f.c", "goodBadMix"]
    assert (mixed.label, mixed.code_snippet) == ("vulnerable", "int goodBadMix(int n)")


def test_ids_are_60_bit(spark, root):
    import hashlib

    rows = tree_snippets(scan_tree(spark, root)).collect()
    for r in rows:
        key = f"{TREE_SOURCE}:{r.file_path}:{r.function_name}"
        assert r.id == int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def test_tree_order_is_c_then_cpp(spark, root):
    tree = scan_tree(spark, root)
    same_id = tree_snippets(tree).withColumn("id", F.lit(1).cast("long"))
    kept = dedup_snippets(same_id, "id").collect()
    assert [(r.file_path, r.function_name) for r in kept] == [("CWE121_Stack/f.c", "goodBadMix")]


SOURCE = """/* int commented(void) { return 0; } */
#define M(x) int macro(x) { }
static inline unsigned long
sum_all(const int *v, size_t n)
{
    unsigned long s = 0; /* } */
    for (size_t i = 0; i < n; i++) { s += v[i]; }
    if (s == '}') { return 0; }
    return s; // }
}

int proto(int a);
char *pointer_result(void) { return 0; }
int f() { return 1; }
struct point make_point(int x, int (*cb)(int)) {
    puts("{ \\" {");
    else if (x) { return cb(x); }
    while (x) { x--; }
}
int open_ended(void) {
    if (1) {
"""


def test_all_functions(spark):
    files = spark.createDataFrame([("a.c", SOURCE), ("b.c", "no code"), ("c.c", "")], "file_path string, text string")
    rows = {r.name: r for r in all_functions(files).collect()}
    # the pointer result and the short one are not listed, the unbalanced one has no end
    assert set(rows) == {"sum_all", "make_point", "f"}
    assert (rows["sum_all"].start_line, rows["sum_all"].end_line) == (3, 10)
    assert rows["sum_all"].code.startswith("static inline unsigned long\nsum_all(")
    assert rows["sum_all"].code.endswith("return s; // }\n}")
    assert (rows["make_point"].start_line, rows["make_point"].end_line) == (15, 19)


def test_short_functions_are_dropped(spark):
    files = spark.createDataFrame([("a.c", "int f(){return 1;}\nint gg(){return 10;}\n")], "file_path string, text string")
    assert [r.name for r in all_functions(files).collect()] == ["gg"]


def test_read_sources_keeps_line_ends(spark, root):
    [row] = read_sources(spark, f"{root}/CWE121_Stack/g.c").collect()
    assert row.text.count("\r\n") == 7
    assert row.file_path.endswith("CWE121_Stack/g.c") and row.file_path.startswith("/")


def scanned_files(df):
    """Files opened by the scan of an executed plan."""
    found = []

    def walk(node):
        if node.nodeName().startswith("Scan"):
            found.append(node.metrics().get("numFiles").get().value())
        children = node.children()
        for at in range(children.size()):
            walk(children.apply(at))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_files_out_of_scope_are_not_opened(spark, root):
    assert scanned_files(scan_tree(spark, root)) == [7]
    assert scanned_files(tree_snippets(scan_tree(spark, root))) == [5]


@pytest.mark.parametrize("header", [
    "__attribute__((noinline)) int f(int a) {", "int f(int a) __attribute__((x)) {", "std::string f(int q) {",
    "void f(int (*cb)(int, int (*)(void))) {", "static const\nunsigned int f(void)\n{", "MACRO(x)\nint f(int a) {",
])
def test_headers_found(header):
    from threatloom.operators.extract import _function_spans

    assert [hit[0] for hit in _function_spans(f"int a;\n{header}\n  return g(1);\n}}\n")] == ["f"]


@pytest.mark.parametrize("text", ["word\n", "\n", "int a(\n", "void bad\n", "x { } ", "f((("])
def test_extraction_is_linear(text):
    import time

    from threatloom.operators.extract import _function_spans, _labelled_spans

    def seconds(copies):
        source, start = text * copies, time.process_time()
        list(_function_spans(source))
        list(_labelled_spans(source))
        return time.process_time() - start

    seconds(1000)
    assert seconds(100_000) < 5  # quadratic patterns took minutes


def test_blank_lines_before_a_labelled_header():
    from threatloom.operators.extract import _labelled_spans

    text = "int a;\n\n \n  void one_bad()\n{\n}\n\n\nint two_good(int a)\n{\n}"
    assert [(name, at) for name, _, at in _labelled_spans(text)] == [("one_bad", 7), ("two_good", text.index("\n\nint two"))]


def test_a_named_file_needs_no_suffix(spark, tmp_path):
    (tmp_path / "a.cc").write_text("int f(int a) { return a; }")
    (tmp_path / "b.c").write_text("int g(int a) { return a; }")
    (tmp_path / "c.h").write_text("int h(int a) { return a; }")
    named = read_sources(spark, str(tmp_path / "a.cc"))
    assert [r.name for r in all_functions(named).collect()] == ["f"]
    both = read_sources(spark, [str(tmp_path), str(tmp_path / "a.cc")])
    assert sorted(r.name for r in all_functions(both).collect()) == ["f", "g"]


PROBES = {
    "words": lambda n: "word\n" * n + "f(int a) { return 1; }",
    "blank lines": lambda n: "\n" * n + "int f(int a) { return 1; }",
    "attributes": lambda n: "__attribute__((x)) " * n + "int f(int a) { return 1; }",
    "brackets": lambda n: "<" * n + " int f(int a) { return 1; }",
    "nested brackets": lambda n: "T" + "<" * n + ">" * n + " f(int a) { return 1; }",
    "square brackets": lambda n: "[[" * n + " int f(int a) { return 1; }",
    "escaped quotes": lambda n: '"' + '\\"' * n + "\nint f(int a) { return 1; }",
    "hashes": lambda n: "x" + " #" * n + "\nint f(int a) { return 1; }",
}


@pytest.mark.parametrize("probe", PROBES)
def test_extraction_takes_time_in_proportion_to_the_text(probe):
    from time import perf_counter

    from threatloom.operators.extract import _function_spans

    def seconds(n):
        text = PROBES[probe](n)
        took = []
        for _ in range(3):
            start = perf_counter()
            list(_function_spans(text))
            took.append(perf_counter() - start)
        return min(took)

    # four times the text in far less than sixteen times the time; a quadratic pass over it would take many seconds
    assert seconds(80_000) < 8 * seconds(20_000) + 0.05


def test_extraction_sees_through_attributes_and_templates():
    from threatloom.operators.extract import _function_spans

    text = (
        "[[nodiscard]] int a(int x) { return 1; }\n"
        "std::map<int, std::vector<T> > b(void) const noexcept { return {}; }\n"
        "__attribute__((format(printf, 1, 2))) static void c(char *s) __attribute__((cold)) { }\n"
        "namespace n { int d() { if (x) { } while (y) { } return 2; } }\n"
        "alignas(8) int e(int (*f)(int), int g[[maybe_unused]]) { return '}'; }\n"
        "#define M(x) {\\\n  {\n"
        "int h() { /* } */ return 0; } // {\n"
        "int unclosed() { \n"
    )
    found = [(n, first, last) for n, _, first, last in _function_spans(text)]
    assert found == [("a", 1, 1), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4), ("e", 5, 5), ("h", 8, 8)]


def test_files_that_cannot_be_read(spark, tmp_path):
    from pyspark.sql import Observation

    from threatloom.sources.tree import scan_files, unread_files

    for name, text in (("a.c", b"int a;"), ("b.c", b"int \xff;"), ("c.c", b"int c;")):
        (tmp_path / name).write_bytes(text)
    seen = Observation()
    assert scan_tree(spark, str(tmp_path), seen=seen).count() == 3
    scan_tree(spark, str(tmp_path), seen=(again := Observation())).collect()
    assert again.get == {"rows": 3, "repaired": 1}
    lenient, strict = (scan_files(spark, str(tmp_path), strict=s).select("path", F.length("content").alias("n")) for s in (False, True))
    (tmp_path / "c.c").unlink()  # listed, then gone
    rows = lenient.collect()
    assert {r.path.split("/")[-1] for r in rows} == {"a.c", "b.c"}
    with pytest.raises(Exception, match="c.c"):
        strict.collect()
    (tmp_path / "c.c").write_bytes(b"int c;")
    read = spark.createDataFrame(rows)
    assert [(r.path.split("/")[-1], r.bytes, r.reason) for r in unread_files(spark, str(tmp_path), read).collect()] == [("c.c", 6, "unreadable")]


def test_packed_trees_are_scanned_like_plain_ones(spark, tmp_path):
    """Gzip files count by the name and content of the file in them, bytes that are no UTF-8 and odd names included."""
    import gzip

    from threatloom.sources.tree import scan_tree as scan

    files = {"CWE121_a/x +%41.cpp": b"void f_bad(void)\r\n{\n}\n\xff", "plain/y.c": b"int g;\r", "plain/z.h": b"no"}
    for name, content in files.items():
        for root, data, end in (("plain", content, ""), ("packed", gzip.compress(content), ".gz")):
            target = tmp_path / root / (name + end)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(data)
    plain, packed = (
        sorted(tuple(r) for r in scan(spark, str(tmp_path / root), packed=root == "packed").collect()) for root in ("plain", "packed")
    )
    assert plain == packed and len(plain) == 2


def test_landed_tree_is_small(spark, sf_dir, tmp_path, monkeypatch):
    """The tree of `scan_tree` is written in gzip files."""
    from threatloom.queries import QUERIES, snippets

    monkeypatch.setattr(snippets, "run_dir", lambda session, name: str(tmp_path / name))
    assert QUERIES["scan_tree"](spark, sf_dir).count()
    landed = list(tmp_path.glob("tree/cwe_dir=*/[!_.]*"))
    assert landed and {f.suffix for f in landed} == {".gz"}


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_labelled_functions_of_many_texts_equal_those_of_each(monkeypatch, size):
    """Lines and braces are found in slices of texts, with what the plain pattern finds in each text by itself."""
    import random

    import pyarrow as pa

    from threatloom.operators import extract

    monkeypatch.setattr(extract, "_SLICE_BYTES", size)
    pieces = [
        "void", "int", "char", "char *", "char*", "static", "static void", "INT", "\u0131nt", "\u017ftatic", "bad", "goodG2B", "a_BAD_1", "x", "(", "()",
        "(int a,\n int b)", ")", "{", "}", "{ }", "}\n", ";", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0c", "\x1c", "\x85", "é",
        "void a_bad() {", "int b_good()\n{\n", "static\nvoid\nc_bad()", " " * 70 + "int q_bad()",
    ]
    dice = random.Random(7)
    texts = ["".join(dice.choice(pieces) + dice.choice(["", " ", "\n"]) for _ in range(dice.randrange(25))) for _ in range(4000)]
    texts += [None, "", FILES["CWE121_Stack/s01/a_bad.c"].decode(), "}}" + FILES["CWE78_OS/c.c"].decode(), "void bad()\n{{{}"]
    plain = [(at, hit) for at, text in enumerate(texts) if text for hit in extract._labelled_spans(text)]
    assert list(extract._labelled_in(pa.array(texts, pa.string()))) == plain
    assert len(plain) > 500
    assert list(extract._labelled_in(pa.array([], pa.string()))) == []
