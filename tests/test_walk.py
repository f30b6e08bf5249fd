"""The walk of a repository: suffixes, ignore rules, and as many tasks as there is work."""

from lodestrata.sources import repository


def write(root, path, text="x = 1\n"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def test_suffixes_and_the_roots_own_rules(spark, tmp_path):
    for path in ("a.py", "b.mts", "c.cts", "d.mdx", "e.d.mts", "lib/deep/er/f.go", "node_modules/g.js", "out/h.py", "out2/i.py", "j.bin", "lib/__init__.py", "k.gen.py"):
        write(tmp_path, path)
    write(tmp_path, ".gitignore", "# made\nout/\n*.gen.py\n")
    found = {r.path: r.language for r in repository.walk(spark, str(tmp_path), "r").collect()}
    assert found == {"a.py": "python", "b.mts": "typescript", "c.cts": "typescript", "d.mdx": "markdown", "lib/deep/er/f.go": "go", "out2/i.py": "python", "lib/__init__.py": "python"}
    every = {r.path for r in repository.walk(spark, str(tmp_path), "r", rules=["lib/", "!lib/deep/"]).collect()}
    assert {"out/h.py", "k.gen.py", "lib/deep/er/f.go"} <= every and "lib/__init__.py" not in every


def test_files_are_read_by_many_tasks(spark, tmp_path):
    for i in range(85):
        write(tmp_path, f"p{i % 9}/q/f{i}.py")
    kept = repository.walk(spark, str(tmp_path), "r")
    assert kept.count() == 85 and kept.rdd.getNumPartitions() >= 4
    assert len([n for n in kept.rdd.glom().map(len).collect() if n]) >= 4


def test_an_empty_folder_has_no_files(spark, tmp_path):
    assert repository.walk(spark, str(tmp_path), "r").count() == 0
