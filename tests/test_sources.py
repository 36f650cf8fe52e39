"""Class files compiled from our own sources, the scan of files and jars, and the command line."""

import io
import shutil
import subprocess
import zipfile

import pytest

from loomgraph import cli
from loomgraph.functions import filters as nf
from loomgraph.plans.view import ElemType
from loomgraph.sources import assemble, classfile, scan
from tests.test_graph import EDGES, OBJ, SIZE, graph_of, n

JAVA = {
    "p/A.java": """package p;
import java.util.*;
@q.Mark(kind = Thread.class) public class A<T extends Comparable<T>> extends q.Base implements Runnable {
  protected Map<String, ? super Integer>[] field; private java.net.URI hidden;
  public A(q.Mark.In x) throws java.io.IOException { }
  public void run() { Object o = new java.util.concurrent.atomic.AtomicLong(); long l = 5L; double d = 2.5; Runnable r = () -> System.out.println(o); }
  private java.sql.Date secret() { return null; }
  static class Hidden { public java.net.URL url; } public static class Shown { public java.net.URL url; }
}""",
    "q/Base.java": "package q; public class Base { }",
    "q/Mark.java": "package q; public @interface Mark { Class<?> kind() default String.class; class In { } }",
    "q/Rec.java": "package q; record Rec(java.util.List<Base> all, int n) { }",
}


@pytest.fixture(scope="module")
def compiled(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    top = tmp_path_factory.mktemp("java")
    for name, text in JAVA.items():
        (top / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (top / "src" / name).write_text(text)
    subprocess.run(["javac", "-d", str(top / "out"), *[str(top / "src" / x) for x in JAVA]], check=True, timeout=120)
    with zipfile.ZipFile(top / "some.jar", "w") as jar:
        for f in sorted((top / "out").rglob("*.class")):
            jar.write(f, str(f.relative_to(top / "out")))
        jar.writestr("q/Empty.class", b"")
        jar.writestr("note.txt", b"x")
    return top


def test_decoder(compiled):
    read = lambda name, api=False: classfile.decode((compiled / "out" / name).read_bytes(), api)
    name, deps = read("p/A.class")
    assert name == "p.A"
    assert {"q.Base", "q.Mark", "q.Mark$In", "java.lang.Thread", "java.util.Map", "java.lang.Integer", "java.net.URI", "java.io.IOException", "java.sql.Date", "java.util.concurrent.atomic.AtomicLong", "java.lang.Comparable"} <= set(deps)
    assert "p.A" not in deps
    _, api = read("p/A.class", True)
    assert {"q.Base", "java.lang.Runnable", "java.util.Map", "java.lang.Integer", "java.lang.String", "q.Mark$In", "java.io.IOException", "java.lang.Comparable"} <= set(api)
    assert not {"q.Mark", "java.lang.Thread", "java.net.URI", "java.sql.Date", "java.util.concurrent.atomic.AtomicLong"} & set(api)
    assert read("p/A$Hidden.class", True)[1] == [] and "java.net.URL" in read("p/A$Shown.class", True)[1]
    assert read("q/Rec.class", True)[1] == [] and {"java.util.List", "q.Base", "java.lang.Record"} <= set(read("q/Rec.class")[1])
    assert classfile.decode(b"") == classfile.decode(b"text") == (None, [])
    assert classfile.signature_names("<T:Ljava/lang/Object;U::La/B<TT;>;>(TT;[La/C<*>.D<+La/E;>;I)V^La/F;") == {"java/lang/Object", "a/B", "a/C", "a/E", "a/F"}
    assert classfile.modified_utf8(b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80") == "a\0\U0001f600"


def test_attributes_of_later_versions_do_not_count():
    def deps(version, api=False, access=assemble.PUBLIC):
        w = assemble.ClassWriter("a/A", "b/B", access, version)
        w.field(assemble.PUBLIC, "f", "Lc/C;", w.signature("Ld/D<Le/E;>;"))
        w.method(assemble.PRIVATE, "m", "()V", w.exceptions("x/X"))
        w.attributes.append(w.annotations("Lm/M;"))
        return classfile.decode(w.bytes(), api)[1]

    assert deps((48, 0)) == ["b.B", "c.C", "x.X"] and deps((49, 0)) == ["b.B", "c.C", "d.D", "e.E", "m.M", "x.X"]
    assert deps((45, 2)) == deps((48, 0)) and deps((52, 0), True) == ["b.B", "c.C", "d.D", "e.E"]
    assert deps((52, 0), True, access=0) == []


def test_directories_on_the_way(spark, tmp_path):
    """A directory that isn't accepted hides what is below it; the path itself is a directory too."""
    for name in ("a/A", "a/b/B", "c/C"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.class").write_bytes(assemble.ClassWriter(name).bytes())
    found = lambda f: {r["name"] for r in scan.decoded(spark, [str(tmp_path)], filters=scan.ParsingFilters(directory=f)).collect()}
    assert found(nf.ANY) == {"a.A", "a.b.B", "c.C"} and found(nf.negated(nf.ends_with("/a"))) == {"c.C"}
    assert found(nf.negated(nf.ends_with("/b"))) == {"a.A", "c.C"} and found(nf.negated(nf.ends_with(tmp_path.name))) == set()


def test_scan(spark, compiled):
    code = scan.code_graph(spark, [str(compiled / "out")])
    sizes = {r["name"]: r["byte_size"] for r in code.class_vertices.collect()}
    total = sum((compiled / "out/p" / f"A{x}.class").stat().st_size for x in ("", "$Hidden", "$Shown"))
    assert sizes["p.A"] == total and sizes["java.lang.Object"] == 0 and "p.A$Hidden" not in sizes
    jar = scan.code_graph(spark, [str(compiled / "some.jar")], merge_nested=False)
    assert {"p.A$Hidden", "q.Rec"} <= {r["name"] for r in jar.class_vertices.collect()} and "q.Empty" not in {r["name"] for r in jar.files.collect()}
    both = scan.code_graph(spark, [str(compiled / "out"), str(compiled / "some.jar")])
    assert {r["name"]: r["byte_size"] for r in both.class_vertices.collect()} == sizes
    assert ("p", "q") in {(r["src"], r["dst"]) for r in code.graph(ElemType.PACKAGE).edges.collect()}


def said(spark, *args):
    out = io.StringIO()
    code = graph_of(spark, [(n(a), n(b)) for a, b in EDGES] + [(n(i), OBJ) for i in SIZE], [(n(i), s) for i, s in SIZE.items()])
    cli.run(["x.jar", *args], out, lambda cmd: code)
    return out.getvalue().splitlines()


def test_command_line(spark):
    lines = said(spark, "-depsof", n(2).replace(".", r"\."), "-steps")
    assert lines[0].startswith("args: [x.jar, -depsof") and lines[1] == "step 1:" and lines[-1] == "total byte size: 2490" and lines[-2] == "number of classes: 5"
    assert said(spark, "-spath", ".*C2", ".*C4", "-nostats")[1:] == [n(2), n(5), n(4)]
    assert said(spark, "-spath", ".*C2", "nothing")[-1] == "no path"
    assert said(spark, "-cycles", "-maxsize", "2", "-onlystats")[-2:] == ["number of size 2: 3", "number of results: 3"]
    assert said(spark, "-sccs", "-maxcount", "1")[1].startswith("SCC 1 (2 elements")
    dot = said(spark, "-gdepsof", ".*C8", "-dotformat")
    assert dot[0].startswith("// args: [") and f'   "{n(9)}" -> "{n(8)}";' in dot
    assert any(x.strip() == n(5) for x in said(spark, "-gdepsof", ".*p1", "-packages"))
    for wrong in (["-depsof", "a", "-minsize", "3"], [], ["-sccs", "-cycles"], ["-sccs", "-nostats", "-onlystats"], ["-spath", "a"]):
        with pytest.raises(SystemExit):
            cli.command(["x.jar", *wrong])


def test_stream_of_class_files(spark, compiled, tmp_path):
    from loomgraph.streaming import incremental

    came = tmp_path / "came"
    shutil.copytree(compiled / "out" / "q", came / "q")
    sizes = []
    for _ in range(2):
        incremental.start(incremental.decoded_stream(spark, str(came)), str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(60)
        sizes.append({r["name"] for r in incremental.graph_so_far(spark, str(tmp_path / "table")).files.collect()})
        shutil.copytree(compiled / "out" / "p", came / "p", dirs_exist_ok=True)
    assert sizes == [{"q.Base", "q.Mark", "q.Rec"}, {"q.Base", "q.Mark", "q.Rec", "p.A"}]
