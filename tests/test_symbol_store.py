"""Symbols kept from run to run, on libraries made here."""

import shutil
import subprocess

import pytest

from stackloom.model import ResolveStrategy
from stackloom.operators.resolve import find_symbols
from stackloom.operators.symbol_store import SymbolStore, build_identity

pytestmark = pytest.mark.skipif(not all(map(shutil.which, ("as", "ld", "addr2line", "nm"))), reason="needs an assembler")
FRAME = "library_name string, offset long"


def _linked(folder, *names, identity=True):
    """A library with functions of these names and line information, and their offsets; the i-th begins at line 5 + 6i."""
    (folder / "x.s").write_text(".text\n" + "".join(f".globl {n}\n.type {n},@function\n{n}:\nnop\nret\n.size {n}, .-{n}\n" for n in names))
    subprocess.run(["as", "-g", "-o", "x.o", "x.s"], check=True, cwd=folder)
    subprocess.run(["ld", "-shared", f"--build-id={'sha1' if identity else 'none'}", "-o", "libx.so", "x.o"], check=True, cwd=folder)
    rows = subprocess.run(["nm", "libx.so"], check=True, cwd=folder, capture_output=True, text=True).stdout.splitlines()
    return str(folder / "libx.so"), {x.split()[2]: int(x.split()[0], 16) for x in rows if " T " in x}


def _counting(folder):
    """The real tool, which notes each call and how much it was asked."""
    log, tool = folder / "calls", folder / "tool"
    log.write_text("")
    tool.write_text(f'#!/bin/sh\necho call >> {log}\nexec addr2line "$@"\n')
    tool.chmod(0o755)
    return str(tool), lambda: len(log.read_text().split())


def test_a_second_run_asks_nothing(spark, tmp_path):
    library, at = _linked(tmp_path, "one", "two")
    tool, calls = _counting(tmp_path)
    # One offset without a symbol, a library that isn't there, and rows that name nothing.
    frames = spark.createDataFrame([(library, at["one"]), (library, at["two"]), (library, at["two"]), (library, 1 << 40), ("/no/such.so", 7), ("[unknown]", 3), (None, 3), (library, None)], FRAME)
    store = SymbolStore(spark, f"file://{tmp_path}/store")
    first = sorted(map(tuple, store.symbols(frames, tool).collect()))
    assert [(r[0], r[2], r[4]) for r in first] == sorted([(library, "one", 5), (library, "two", 11)], key=lambda r: at[r[1]])
    asked = calls()
    assert asked > 0
    again = SymbolStore(spark, f"file://{tmp_path}/store")
    assert sorted(map(tuple, again.symbols(frames, tool).collect())) == first and calls() == asked
    assert again.answers.where("function_name is null").count() == 1 and again.answers.count() == 3
    found = find_symbols(frames, spark.createDataFrame([(library, at["one"], "mine", "m.c", 1)], "library string, offset long, function_name string, filename string, line_number int"), ResolveStrategy.AutoFallback, tool, again)
    assert {(r["offset"], r["function_name"]) for r in found.collect()} == {(at["one"], "mine"), (at["two"], "two")} and calls() == asked


def test_another_build_is_asked_about_anew(spark, tmp_path):
    tool, calls = _counting(tmp_path)
    store = SymbolStore(spark, f"file://{tmp_path}/store")
    names, builds = [], []
    for name, identity in (("old", True), ("new", True), ("plain", False)):
        library, at = _linked(tmp_path, name, identity=identity)
        builds.append(build_identity(library))
        names += [r["function_name"] for r in store.symbols(spark.createDataFrame([(library, next(iter(at.values())))], FRAME), tool).collect()]
    assert names == ["old", "new", "plain"] and calls() == 3
    assert [b.split(":")[0] for b in builds] == ["gnu", "gnu", "sha256"] and len(set(builds)) == 3


def test_failures_are_no_answers(spark, tmp_path):
    library, at = _linked(tmp_path, "one")
    frames = spark.createDataFrame([(library, at["one"])], FRAME)
    store = SymbolStore(spark, f"file://{tmp_path}/store")
    assert store.symbols(frames, "false").count() == 0 and store.symbols(frames, "no-such-tool").count() == 0 and store.answers.count() == 0
    assert store.symbols(frames, None).count() == 0 and store.symbols(frames).count() == 1
    assert store.symbols(frames.limit(0)).count() == 0


def test_files_that_are_no_libraries(tmp_path):
    (tmp_path / "short").write_bytes(b"\x7fELF\x02\x01")
    (tmp_path / "text").write_bytes(b"text")
    assert build_identity(str(tmp_path / "short")).startswith("sha256:") and build_identity(str(tmp_path / "text")).startswith("sha256:") and build_identity(str(tmp_path)) == ""
