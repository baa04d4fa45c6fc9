"""Git packs and large dumps, read by many tasks."""

import os
import random
import subprocess

from pyspark.sql import functions as F

from reuselens.sources import files, packs


def git(folder, *what):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "GIT_CONFIG_NOSYSTEM": "1", "HOME": str(folder)}
    return subprocess.run(["git", "-C", str(folder), *what], check=True, capture_output=True, env=env).stdout


def test_files_of_commits(spark, tmp_path):
    rng, want = random.Random(1), {}
    git(tmp_path, "init", "-q", ".")
    lines = [f"line {rng.randrange(10**9)}" for _ in range(400)]
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for k in range(12):
        lines[rng.randrange(400)] = f"changed {k}"
        (tmp_path / "big.txt").write_text("\n".join(lines))
        (tmp_path / "deep" / "er" / "é x.cpp").write_text(f"int f() {{ return {k // 4}; }}")
        (tmp_path / "empty").write_text("")
        git(tmp_path, "add", "-A")
        git(tmp_path, "commit", "-q", "-m", str(k))
        commit = git(tmp_path, "rev-parse", "HEAD").decode().strip()
        want |= {(commit, p): (tmp_path / p).read_bytes() for p in ("big.txt", "deep/er/é x.cpp", "empty")}
    for how in ("true", "false"):  # deltas against offsets, then against ids
        git(tmp_path, "config", "repack.useDeltaBaseOffset", how)
        git(tmp_path, "repack", "-q", "-a", "-d", "-f", "--depth=50", "--window=50")
        folder = str(tmp_path / ".git" / "objects" / "pack")
        raw = [e for p in os.listdir(folder) if p.endswith(".pack") for e in packs.entries(open(f"{folder}/{p}", "rb").read())]
        assert sum(e[1] == ("offset delta" if how == "true" else "id delta") for e in raw) > 5
        objects = packs.pack_objects(spark, folder)
        assert objects.count() == len(raw)
        assert set(git(tmp_path, "rev-list", "--objects", "--all", "--no-object-names").decode().split()) == {r.sha for r in objects.select("sha").collect()}
        got = {(r.commit, r.path): bytes(r.content) for r in packs.commit_files(objects).collect()}
        assert got == want
    last = spark.createDataFrame([(commit,)], "sha string")
    assert {r.path for r in packs.commit_files(objects, last).collect()} == {"big.txt", "deep/er/é x.cpp", "empty"}
    assert packs.commit_files(objects.limit(0)).count() == 0


def test_a_dump_is_split(spark, tmp_path):
    rows = [f'  <row Id="{k}" CreationDate="2024" Body="&lt;code&gt;int x{k} &amp;lt; 1;&lt;/code&gt; &#xA; é" ContentLicense="CC BY-SA" />' for k in range(5000)]
    (tmp_path / "Posts.xml").write_text('<?xml version="1.0" encoding="utf-8"?>\n<posts>\n' + "\n".join(rows) + '\n  <row Id="7000" />\n</posts>\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        posts = files.dump_posts(spark, str(tmp_path / "Posts.xml"))
        assert posts.rdd.getNumPartitions() > 4
        assert posts.count() == posts.select("snippet_id").distinct().count() == 5001
        assert posts.where("snippet_id = 7000").select("licence", "body").first() == ("", "")
        got = {r.snippet_id: r.code for r in files.dump_snippets(posts).collect()}
        assert got == {k: f"int x{k} < 1;" for k in range(5000)} and {r.licence for r in posts.where("snippet_id < 5000").select("licence").distinct().collect()} == {"CC BY-SA"}
        assert posts.agg(F.min("date")).first()[0] == "2024"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
