import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine, load_config, parse_bool, to_json, to_text
from lodestone.embed import CachedEmbedder, HashingEmbedder, HttpEmbedder, LengthEmbedder, PooledEmbedder, RetryingEmbedder, batch_size, batches, model_embedder, spread_batches
from lodestone.plans.planner import SearchOptions
from lodestone.sources import remote, repo, store, syntax
from lodestone.streaming import watch

PY = '''import os
from a.b import c as d

LIMIT = 3


class Parser:
    """Reads."""

    def parse_tokens(self, text):
        return helper(text)


@cached
def helper(text):
    return os.path.join(text)
'''
RUST = "use std::fs;\n\npub struct Store { path: String }\n\nimpl Store {\n    pub fn load(&self) -> i32 {\n        read_it(\"}\")\n    }\n}\n\nfn read_it(s: &str) -> i32 { 1 }\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {
        "src/parser.py": PY, "src/store.rs": RUST, "README.md": "# Title\n\nintro about parsing\n\n## Use\n\nmore text\n", "notes.txt": "plain text file\nabout nothing\n",
        "node_modules/x.js": "var x = 1", "img.png": "x", "blank.py": "  \n", ".hidden/a.py": "x = 1", "ignored/a.py": "y = 2", ".gitignore": "ignored/\n*.tmp2\n", "b.tmp2": "x",
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / "bad.py").write_bytes(b"\xff\xfe x")
    return root


def test_walk_and_text_files(spark, tree):
    files = repo.text_files(repo.read_repo(spark, str(tree)))
    assert {r["path"]: r["language"] for r in files.collect()} == {"src/parser.py": "python", "src/store.rs": "rust", "README.md": "markdown", "notes.txt": "plain", "blank.py": "python"}


def test_python_syntax():
    symbols, edges, imports = syntax.extract(PY, "p.py", "python")
    assert [(s[1], s[3]) for s in symbols] == [("Parser", "class"), ("parse_tokens", "function"), ("helper", "function")]
    assert {(e[2], e[3]) for e in edges} == {("contains", None), ("calls", "helper"), ("calls", "os.path.join")}
    assert [(i[1], i[2], i[3]) for i in imports] == [("os", None, 1), ("a.b", "d", 2)]


def test_rust_syntax():
    symbols, edges, imports = syntax.extract(RUST, "s.rs", "rust")
    assert [(s[1], s[3], s[5], s[6]) for s in symbols] == [("Store", "struct", 3, 3), ("Store", "struct", 5, 9), ("load", "function", 6, 8), ("read_it", "function", 11, 11)]
    assert imports[0][1] == "std::fs" and ("calls", "read_it") in {(e[2], e[3]) for e in edges}


def test_javascript_go_java_syntax():
    js = "import x from './lib';\nexport class A {\n  run(a) {\n    go(a);\n  }\n}\nfunction top() { return 1; }\nconst f = () => 2;\n"
    assert [(s[1], s[3]) for s in syntax.extract(js, "a.js", "javascript")[0]] == [("A", "class"), ("run", "method"), ("top", "function"), ("f", "variable")]
    assert syntax.extract(js, "a.js", "javascript")[2][0][1] == "./lib"
    go = 'package main\nimport "fmt"\ntype T struct {\n  a int\n}\nfunc (t *T) Do() {\n  fmt.Println(1)\n}\nfunc main() {\n}\n'
    assert {(s[1], s[3]) for s in syntax.extract(go, "a.go", "go")[0]} >= {("Do", "method"), ("main", "function"), ("T", "type")}
    java = "package a.b;\nimport java.util.List;\npublic class K {\n  public int f(int x) {\n    return g(x);\n  }\n}\n"
    assert {(s[1], s[3]) for s in syntax.extract(java, "K.java", "java")[0]} >= {("K", "class"), ("f", "method")}


def test_small_functions_merge_within_limits():
    source = "\n".join(f"def f{i}():\n    a = {i}\n    return a\n" for i in range(100))
    found = syntax.semantic_chunks(source, "python")
    assert len(found) > 1 and all(b - a + 1 <= 200 for a, b, _ in found) and found[0][0] == 1
    assert syntax.semantic_chunks("def broken(:", "python") is None and syntax.semantic_chunks("x", "plain") is None


def test_lifecycle(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path / "store"), CachedEmbedder(HashingEmbedder(64)))
    assert engine.store.build_state() == "missing"
    with pytest.raises(LookupError):
        engine.search("x")
    first = engine.index()
    assert first.mode == "full" and first.files == 5 and first.chunks >= 5 and first.cache_hits == 0
    found = engine.search("parse_tokens helper text reads").collect()
    assert found[0]["path"] == "src/parser.py" and "snippet" in found[0].asDict()
    assert {r["path"] for r in engine.search("parser", SearchOptions(glob=["*.rs"])).collect()} == {"src/store.rs"}
    assert engine.search_files("parser").first()["path"] and engine.search_directories("parser").count() == 2
    assert engine.graph().by_name("helper").count() == 1 and engine.stats()["state"] == "ready"
    again = engine.index()
    assert again.cache_hits == again.chunks == first.chunks
    (tree / "src/store.rs").unlink()
    (tree / "notes.txt").write_text("fresh words here\n")
    changes = spark.createDataFrame([("src/store.rs", "deleted"), ("notes.txt", "touched")], "path string, op string")
    third = engine.index(changes=changes)
    assert third.mode == "incremental" and third.files == 3
    chunks = engine.snapshot().table("chunks")
    assert chunks.where("path = 'src/store.rs'").count() == 0 and "fresh" in chunks.where("path = 'notes.txt'").first()["text"]
    assert engine.graph().in_file("src/store.rs").count() == 0 and engine.graph().by_name("helper").count() == 1
    other = Engine(spark, str(tree), str(tmp_path / "store"), HashingEmbedder(32))
    with pytest.raises(ValueError):
        other.search("x")
    assert other.index(changes=changes).mode == "full"
    meta = other.snapshot().metadata
    doc = json.loads(to_json(other.search("fresh words"), "fresh words", 10, 5, meta))
    assert "notes.txt" in {r["path"] for r in doc["results"]} and doc["index"]["vector_dim"] == 32
    text, status = to_text(other.search("fresh words"))
    assert status == 0 and "notes.txt" in text
    double = remote.MemoryStore()
    double.upsert([r.asDict() for r in remote.rows_of(other.snapshot().table("chunks")).collect()])
    assert "notes.txt" in {r["path"] for r in other.search_remote("fresh words", double).collect()}
    parquet = remote.ParquetStore(spark, str(tmp_path / "remote"))
    parquet.write(other.snapshot().table("chunks"), reset=True)
    assert parquet.query(HashingEmbedder(32).embed_batch(["fresh words"])[0], 3).count() == 3
    other.store.prune()
    assert len([f for f in other.store.files.folders() if f.startswith("snap=")]) == 1


def test_build_marker(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    with s.building():
        assert s.build_state() == "building"
        with pytest.raises(RuntimeError), s.building():
            pass
    s.files.write("BUILDING", json.dumps({"pid": 2**22 + 1, "host": __import__("socket").gethostname()}))
    assert s.build_state() == "interrupted"


def test_worktree(tmp_path):
    (tmp_path / "main/.git/worktrees/w").mkdir(parents=True)
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.git").write_text(f"gitdir: {tmp_path}/main/.git/worktrees/w\n")
    assert store.worktree_main(str(tmp_path / "w")) == str(tmp_path / "main") and store.worktree_main(str(tmp_path / "main")) is None


def test_stream_applies_last_event(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = [{"kind": "create", "paths": ["a"], "ts": "2024-01-01T00:00:00Z"}, {"kind": "rename", "paths": ["a", "b"], "ts": "2024-01-01T00:00:01Z"}, {"kind": "access", "paths": ["z"], "ts": "2024-01-01T00:00:01Z"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    q = watch.run(watch.read_events(spark, str(folder)), lambda c: seen.append({(r["path"], r["op"]) for r in c.collect()}), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == [{("a", "deleted"), ("b", "touched")}]


def test_stream_debounce(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    times = ["00:00:00.000", "00:00:00.300", "00:00:05.000", "00:01:00.000"]
    (folder / "1.json").write_text("\n".join(json.dumps({"kind": "modify", "paths": [f"p{i}"], "ts": f"2024-01-01T{t}Z"}) for i, t in enumerate(times)))
    name = f"t{uuid.uuid4().hex}"
    stream = watch.debounced(watch.read_events(spark, str(folder)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["touched"] for r in spark.table(name).orderBy("started").collect()] == [["p0", "p1"], ["p2"]]


def test_embedders(spark):
    calls = []

    class Flaky(LengthEmbedder):
        def embed_batch(self, texts):
            calls.append(len(texts))
            if len(calls) < 3:
                raise OSError
            return super().embed_batch(texts)

    assert RetryingEmbedder(Flaky(), pause=0).embed_batch(["abc"]) == [[3.0, 1.0, 0.0, 0.0]] and len(calls) == 3
    cached = CachedEmbedder(LengthEmbedder(), capacity=2)
    cached.embed_batch(["a", "a", "bb"])
    cached.embed_batch(["a", "ccc"])
    assert cached.computed == 3 and len(cached.kept) == 2
    assert batch_size() == 64 and batch_size(gpu=True) == 128 and batch_size(5) == 16 and batch_size(9999) == 2048 and spread_batches(64, 100) == 25
    assert [len(b) for b in batches(["w " * 10] * 5, 4, 1000)] == [4, 1] and [len(b) for b in batches(["w " * 10] * 4, 99, 25)] == [2, 2]


def test_http_embedder():
    import gzip


    sizes = []

    def send(url, body, headers, timeout):
        texts = json.loads(gzip.decompress(body))["texts"]
        sizes.append(len(texts))
        return json.dumps({"embeddings": [[float(len(t)), 0.0] for t in texts]}).encode()

    e = HttpEmbedder("http://x", 2, batch=2, compress=True, send=send)
    assert e.embed_batch(["a", "bb", "ccc"]) == [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]] and sizes == [2, 1]
    with pytest.raises(ValueError):
        HttpEmbedder("http://x", 3, compress=True, send=send).embed_batch(["a"])


def test_command_line(spark, tree, tmp_path, capsys):
    from lodestone import cli

    common = ["--store", str(tmp_path / "st")]
    assert cli.main([*common, "search", "x", "--path", str(tree)]) == 2
    assert cli.main([*common, "index", str(tree)]) == 0
    capsys.readouterr()
    assert cli.main([*common, "search", "parser", "--path", str(tree), "--json", "--limit", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)["results"]) <= 2
    assert cli.main([*common, "search", "parser", "--path", str(tree), "--glob", "*.none"]) == 1


def test_remote_batches_and_retry():
    memory = remote.MemoryStore()
    memory.upsert([{"id": str(i), "vector": [1.0]} for i in range(250)])
    assert memory.requests == [100, 100, 50]
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, body))
        if len(sent) == 1:
            raise OSError
        return {"rows": [{"id": "a", "$dist": 0.25}]}

    api = remote.NamespaceApiStore("http://x", "k", "n", pause=0, post=post)
    assert api.query([1.0], 3)[0]["score"] == 0.75 and len(sent) == 2
    api.upsert([{"id": "a", "vector": [1.0], "v": 1}, {"id": "a", "vector": [1.0], "v": 2}])
    assert [r["v"] for r in sent[-1][1]["upsert_rows"]] == [1]
    assert remote.choose({}, "n") is None and remote.choose({"index_api": {"api_key": "k", "endpoint": "e"}}, "n").name == "index-api"


def test_small_parsers(tmp_path):
    assert parse_bool(" Yes ") and not parse_bool("0")
    with pytest.raises(ValueError):
        parse_bool("maybe")
    (tmp_path / "c.toml").write_text('[embedding]\nname = "hashing"\n')
    assert load_config(str(tmp_path / "c.toml")) == {"embedding": {"name": "hashing"}} and load_config(str(tmp_path / "none")) == {}
    assert repo.relative(os.path.join(str(tmp_path), "a/b"), str(tmp_path)) == "a/b"
    assert F is not None


def test_ignore_rules_from_outside_the_tree(spark, tmp_path, monkeypatch):
    home, top = tmp_path / "home", tmp_path / "top"
    root = top / "in" / "src"
    for folder in (home / "git", top / ".git" / "info", root / "deep"):
        folder.mkdir(parents=True)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(home))
    (home / "git" / "ignore").write_text("*.global\n")
    (top / ".git" / "info" / "exclude").write_text("excluded.py\n")
    (top / ".gitignore").write_text("*.up\nin/src/anchored.py\n")
    (root / ".gitignore").write_text("!kept.up\n")
    for name in ("a.py", "b.global", "excluded.py", "c.up", "kept.up", "anchored.py", "deep/anchored.py", "deep/d.up"):
        (root / name).write_text("x = 1\n")
    found = sorted(r["path"] for r in repo.read_repo(spark, str(root)).collect())
    assert found == ["a.py", "deep/anchored.py", "kept.up"]


def test_a_tree_gives_its_own_notifications(spark, tmp_path):
    root, state = tmp_path / "tree", tmp_path / "state"
    (root / "d").mkdir(parents=True)
    (root / "a.py").write_text("a")
    (root / "d" / "b.py").write_text("b")
    reader = watch.TreeReader(str(root), str(state), "")
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    (root / "a.py").unlink()
    (root / "d" / "b.py").write_text("bb")
    (root / "c.py").write_text("c")
    rows, end = reader.read(start)
    got = [(kind, paths) for kind, paths, _ in rows]
    assert got == [("remove", ["a.py"]), ("create", ["c.py"]), ("modify", ["d/b.py"])] and end != start
    assert [(k, p) for k, p, _ in reader.readBetweenOffsets(start, end)] == got
    (root / "c.py").write_text("ccc")
    seen = []
    stream = watch.read_tree(spark, str(root), str(tmp_path / "other"))
    query = watch.run(stream, lambda changes: seen.extend(tuple(r) for r in changes.collect()), str(tmp_path / "cp"), trigger_ms=200)
    try:
        for _ in range(100):
            if os.path.exists(tmp_path / "other" / "000000000000.json"):
                break
            time.sleep(0.1)
        time.sleep(0.5)
        (root / "new.py").write_text("n")
        for _ in range(150):
            if seen:
                break
            time.sleep(0.1)
    finally:
        query.stop()
    assert ("new.py", "touched") in seen


def test_readers_of_other_languages():
    ruby = 'require "json"\nmodule M\n  class A < B\n    def go(x)\n      if x\n        run(x)\n      end\n    end\n\n    def self.make; end\n  end\nend\n\ndef top\n  3\nend\n'
    symbols, edges, imports = syntax.extract(ruby, "a.rb", "ruby")
    assert [(s[1], s[3], s[5], s[6]) for s in symbols] == [("M", "module", 2, 12), ("A", "class", 3, 11), ("go", "method", 4, 8), ("make", "method", 10, 10), ("top", "function", 14, 16)]
    assert imports == [("a.rb", "json", None, 1, False)] and (symbols[2][0], None, "calls", "run") in edges
    spans = lambda source, language: [(a, b) for a, b, _ in syntax.semantic_chunks(source, language) or []]
    rows = "x = 1\n" * 60
    assert spans(f"a = 1\n\n# note\n[t]\n{rows}\n[u]\n{rows}", "toml") == [(1, 64), (66, 126)]
    assert spans("f() {\n" + " echo x\n" * 60 + "}\n\nfunction g {\n ls\n}\n", "bash") == [(1, 62), (64, 66)]
    assert spans("@import 'a';\n.a,\n.b {\n" + " c: d;\n" * 60 + "}\n@media x {\n .e { f: g }\n}\n", "css") == [(2, 64), (65, 67)]
    assert spans('{\n "a": [1, 2]\n}\n', "json") == [(1, 3)] and spans("# c\na:\n  - b\n", "yaml") == [(2, 3)]
    assert syntax.semantic_chunks("<p>x</p>", "html") is None


def test_pools_and_named_models(tmp_path):
    sent = []

    def send(url, body, headers, timeout):
        texts = json.loads(body)["texts"]
        sent.append(len(texts))
        return json.dumps({"embeddings": [[float(len(t)), 0.0] for t in texts]}).encode()

    texts = ["x" * n for n in range(23)]
    assert HttpEmbedder("http://x", 2, batch=4, send=send, workers=8).embed_batch(texts) == [[float(n), 0.0] for n in range(23)]
    assert sorted(sent) == [3, 4, 4, 4, 4, 4]
    pool = PooledEmbedder([LengthEmbedder(2), LengthEmbedder(2), LengthEmbedder(2)], batch=5)
    assert pool.embed_batch(texts) == LengthEmbedder(2).embed_batch(texts) and pool.embed_batch([]) == []
    name, taken = "mxbai-embed-xsmall-v1", []
    with pytest.raises(FileNotFoundError):
        model_embedder(name, str(tmp_path), offline=True)

    def get(url, path):
        taken.append(url)
        with open(path, "w") as f:
            f.write("x")

    found = model_embedder(name, str(tmp_path), offline=False, get=get)
    assert (found.name, found.dimension) == (name, 384) and len(taken) == 5
    assert model_embedder(name, str(tmp_path), offline=True, get=get).name == name and len(taken) == 5


def test_snapshot_is_verified_and_changes_are_pushed(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), str(tmp_path / "st"), LengthEmbedder(4), batch=16)
    engine.index()
    engine.verify()
    before = engine.store.current()
    far = FolderStore(str(tmp_path / "far"))
    engine.push(far, reset=True)
    all_ids = set(far.ids())
    (tree / "fresh.py").write_text("def fresh():\n    return 1\n")
    engine.index(changes=spark.createDataFrame([("fresh.py", "touched")], "path string, op string"))
    engine.push_changes(far, before)
    now = {r["hash"] for r in engine.snapshot().table("chunks").select("hash").collect()}
    assert set(far.ids()) == now and len(now - all_ids) == 1
    wrong = store.Snapshot(spark, before.root, before.snap)
    broken = wrong.table("chunks").limit(1)
    broken.write.parquet(str(tmp_path / "x"))
    meta = wrong.metadata
    assert meta["total_chunks"] > 1
    part = store.Snapshot(spark, str(tmp_path / "st2"), "s")
    spark.read.parquet(str(tmp_path / "x")).write.parquet(str(tmp_path / "st2" / "snap=s" / "chunks"))
    wrong.table("metadata").write.parquet(str(tmp_path / "st2" / "snap=s" / "metadata"))
    with pytest.raises(ValueError):
        part.verify()


class FolderStore:
    """A remote store as files, so that executors of any process reach it."""

    name, batch = "folder", 10

    def __init__(self, folder):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def ids(self):
        return os.listdir(self.folder)

    def upsert(self, rows):
        for r in rows:
            with open(os.path.join(self.folder, r["id"]), "w") as f:
                f.write(r["path"])

    def delete(self, ids):
        for i in ids:
            os.remove(os.path.join(self.folder, i))

    def query(self, vector, k):
        return []

    def delete_namespace(self):
        self.delete(self.ids())


def test_the_pointer_is_replaced_in_one_step(spark, tmp_path):
    files = store._Files(spark, str(tmp_path / "p"))
    files.write("CURRENT", "one")
    seen = []
    real = files.context

    class Watched:
        def rename(self, a, b, how):
            seen.append(files.read("CURRENT"))
            real.rename(a, b, how)

    files.context = Watched()
    files.write("CURRENT", "two")
    assert seen == ["one"] and files.read("CURRENT") == "two"


def test_command_line_options(spark, tree, tmp_path, capsys):
    from lodestone import cli

    config = tmp_path / "c.toml"
    config.write_text("remote_provider = 'none'\n")
    common = ["--store", str(tmp_path / "st"), "--config", str(config)]
    assert cli.main([*common, "config"]) == 0 and json.loads(capsys.readouterr().out) == {"remote_provider": "none"}
    assert cli.main([*common, "index", str(tree), "--json", "--profile", "--batch-size", "16"]) == 0
    out = capsys.readouterr()
    assert json.loads(out.out)["mode"] == "full" and "build:" in out.err
    assert cli.main([*common, "search", "parser", "--path", str(tree), "--debug"]) == 0
    assert "Physical Plan" in capsys.readouterr().err


def test_an_update_writes_the_touched_buckets_only(spark, tree, tmp_path):
    for k in range(30):
        (tree / f"many{k}.py").write_text(f"def many{k}():\n    return shared({k})\n")
    engine = Engine(spark, str(tree), str(tmp_path / "st"), HashingEmbedder(16))
    engine.index()
    first = engine.store.current()
    assert engine.search("many3 shared").count() > 0 and engine.search("many4").count() > 0
    assert (engine.lexicon_misses, engine.lexicon_hits) == (1, 1)
    (tree / "many3.py").write_text("def renewed():\n    return 3\n")
    (tree / "many4.py").unlink()
    report = engine.index(changes=spark.createDataFrame([("many3.py", "touched"), ("many4.py", "deleted")], "path string, op string"))
    now = engine.store.current()
    moved = {b for b, o in now.manifest["chunks"]["owner"].items() if o == now.snap}
    assert report.mode == "incremental" and 1 <= len(moved) <= 2 and len(now.manifest["chunks"]["owner"]) > 10
    # the same tables as those of a build from nothing
    other = Engine(spark, str(tree), str(tmp_path / "other"), HashingEmbedder(16))
    other.index()
    whole = other.store.current()
    for name in ("chunks", "postings", "files", "corpus", "directories", "symbols", "imports"):
        mine, theirs = now.table(name), whole.table(name)
        assert set(mine.columns) == set(theirs.columns)
        cols = [c for c in theirs.columns if c not in ("modified_at", "vector")]
        flat = lambda df, cols=cols: sorted(str(r) for r in df.select(*cols).collect())
        assert flat(mine) == flat(theirs), name
    engine.store.prune()
    assert engine.store.current().table("chunks").count() == whole.table("chunks").count() and first.snap != now.snap
    engine.verify()
