"""Staged changes, constraints, seeds, migrations and streams."""

import pytest

from tessella.operators.changes import ALL_ROWS, Changes, CheckViolation, ForeignKeyViolation, NotNullViolation, UniqueViolation, when
from tessella.operators.migrate import Change, MigrationError, apply, diff, drift, plan, rename_hints, reverse
from tessella.plans.select import NoRow
from tessella.schema import ForeignKey, Model, Relation, validate
from tessella.session import Db
from tessella.sources.introspect import model_of
from tessella.sources.seed import apply_seed
from tessella.streaming import start, streamed

users = Model("users", {"id": "bigint", "name": "string?", "role": "string?"}, allowed={"role": ("admin", "guest")}, unique=(("name",),), defaults={"id": "autoincrement", "role": "'guest'"})


def posts(rule="cascade"):
    return Model("posts", {"id": "bigint", "author": "bigint?"}, foreign=(ForeignKey("author", "users", "id", rule),))


@pytest.fixture
def make(spark):
    def tx(rule="cascade"):
        p = posts(rule)
        tables = {"users": spark.createDataFrame([(1, "a", "admin"), (2, "b", None)], users.schema), "posts": spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], p.schema)}
        return Changes(Db(spark, [users, p], tables=tables)), p

    return tx


def rows(tx, model):
    return sorted((tuple(r) for r in tx.table(model).collect()), key=str)


def test_insert_and_upsert(make):
    tx, _ = make()
    made = tx.insert(users, [{"name": "c"}]).collect()
    assert made[0].id == 3 and made[0].role == "guest"
    tx.upsert(users, [{"id": 1, "name": "z", "role": "guest"}, {"id": 9, "name": "n", "role": None}], ("id",), ("name",))
    assert (1, "z", "admin") in rows(tx, users) and (9, "n", None) in rows(tx, users)
    with pytest.raises(ValueError):
        tx.insert(users, [{"id": 1}, {"name": "x"}])
    with pytest.raises(ValueError):
        tx.insert(users, [])


def test_autoincrement_has_no_gaps(spark):
    small = Model("small", {"id": "int", "name": "string"}, defaults={"id": "autoincrement"})
    tx = Changes(Db(spark, [small], tables={"small": spark.createDataFrame([(7, "a")], small.schema)}))
    tx.insert(small, [{"name": str(i)} for i in range(20)])
    assert sorted(r.id for r in tx.table(small).collect()) == list(range(7, 28)) and [r.id for r in tx.table(small).where("name = '0'").collect()] == [8]
    tx.insert(small, spark.range(30, numPartitions=4).selectExpr("CAST(id AS STRING) AS name").where("name <> '3'"))
    assert sorted(r.id for r in tx.table(small).collect())[1:] == list(range(8, 57))


def test_upsert_of_repeated_keys(make):
    tx, _ = make()
    with pytest.raises(ValueError):
        tx.upsert(users, [{"id": 1, "name": "x", "role": None}, {"id": 1, "name": "y", "role": None}], ("id",), ("name",))
    tx.upsert(users, [{"id": 5, "name": "x", "role": None}, {"id": 5, "name": "y", "role": None}], ("id",))
    assert [r for r in rows(tx, users) if r[0] == 5] == [(5, "x", None)]
    tx.upsert(users, tx.db.spark.createDataFrame([(5, "q", None), (5, "p", None), (6, "n", None)], users.schema), ("id",), ("name",))
    assert [r for r in rows(tx, users) if r[0] in (5, 6)] == [(5, "p", None), (6, "n", None)]


def test_upsert_of_null_keys(spark):
    m = Model("m", {"id": "bigint", "code": "string?"})
    tx = Changes(Db(spark, [m], tables={"m": spark.createDataFrame([(1, None)], m.schema)}))
    tx.upsert(m, [{"id": 2, "code": None}, {"id": 3, "code": None}], ("code",), ("id",))
    assert rows(tx, m) == [(1, None), (2, None), (3, None)]


def test_update_and_delete(make):
    tx, p = make()
    with pytest.raises(TypeError):
        tx.delete(p, None)
    with pytest.raises(ValueError):
        tx.update(p, ALL_ROWS)
    assert tx.affected(p, p.author.eq(1)) == 2
    assert tx.delete(p, p.author.eq(1)).count() == 2
    assert rows(tx, p) == [(12, 2), (13, None)]  # a null predicate keeps its row
    tx.update(p, ALL_ROWS, author=None)
    assert rows(tx, p) == [(12, None), (13, None)]


@pytest.mark.parametrize(("rule", "left"), [("cascade", [(12, 2), (13, None)]), ("set_null", [(10, None), (11, None), (12, 2), (13, None)])])
def test_on_delete(make, rule, left):
    tx, p = make(rule)
    tx.delete(users, users.id.eq(1))
    assert rows(tx, p) == left


def test_deletes_count_children(make):
    tx, _ = make()
    assert tx.delete(users, users.id.eq(1)).count() == 3
    assert tx.delete(users, when(None, users.id.eq)).count() == 2
    assert rows(tx, users) == []


@pytest.mark.parametrize(("rule", "left"), [("cascade", [(5, None)]), ("set_null", [(2, None), (3, 2), (4, 3), (5, None), (6, None)])])
def test_self_reference(spark, rule, left):
    node = Model("node", {"id": "bigint", "up": "bigint?"}, foreign=(ForeignKey("up", "node", "id", rule),))
    tx = Changes(Db(spark, [node], tables={"node": spark.createDataFrame([(1, 4), (2, 1), (3, 2), (4, 3), (5, None), (6, 1)], node.schema)}))
    tx.delete(node, node.id.eq(1))  # 1, 2, 3 and 4 form a circle
    assert rows(tx, node) == left
    tx.check()


def test_cascade_over_models_in_a_circle(spark):
    a = Model("a", {"id": "bigint", "b": "bigint?"}, foreign=(ForeignKey("b", "b", "id", "cascade"),))
    b = Model("b", {"id": "bigint", "a": "bigint?"}, foreign=(ForeignKey("a", "a", "id", "cascade"),))
    tx = Changes(Db(spark, [a, b], tables={"a": spark.createDataFrame([(1, None), (2, 10), (3, None)], a.schema), "b": spark.createDataFrame([(10, 1), (11, 2), (12, 3)], b.schema)}))
    assert tx.delete(a, a.id.eq(1)).count() == 4
    assert rows(tx, a) == [(3, None)] and rows(tx, b) == [(12, 3)]


def test_plans_of_a_cascade_do_not_grow_with_its_depth(spark):
    node = Model("node", {"id": "bigint", "up": "bigint?"}, foreign=(ForeignKey("up", "node", "id", "cascade"),))

    def size(depth):
        chain = spark.range(1, depth + 2).selectExpr("id", "CASE WHEN id > 1 THEN id - 1 END AS up")
        tx = Changes(Db(spark, [node], tables={"node": chain}))
        assert tx.delete(node, node.id.eq(2)).count() == depth
        assert rows(tx, node) == [(1, None)]
        return len(tx.table(node)._jdf.queryExecution().optimizedPlan().toString())

    assert size(8) < 1.2 * size(2)
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/cascade-*")
    assert not list(fs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs))  # levels are deleted


def test_dangling_children_of_a_deleted_parent(make, tmp_path):
    tx, _ = make("no_action")
    tx.delete(users, users.id.eq(1))
    with pytest.raises(ForeignKeyViolation):
        tx.commit(str(tmp_path))
    assert not list(tmp_path.rglob("*.parquet")) and "users" in tx.staged
    tx.update(tx.db.models["posts"], ALL_ROWS, author=None)
    tx.commit(str(tmp_path))


def test_restrict(make):
    tx, _ = make("restrict")
    with pytest.raises(ForeignKeyViolation):
        tx.delete(users, users.id.eq(1))


def test_constraints(make):
    for change, error in (
        (lambda t, p: t.insert(users, [{"id": 1, "name": "q"}]), UniqueViolation),
        (lambda t, p: t.insert(users, [{"id": 5, "name": "a"}]), UniqueViolation),
        (lambda t, p: t.insert(users, [{"id": 5, "role": "king"}]), CheckViolation),
        (lambda t, p: t.insert(p, [{"id": 20, "author": 77}]), ForeignKeyViolation),
        (lambda t, p: t.update(users, ALL_ROWS, id=None), NotNullViolation),
    ):
        tx, p = make()
        change(tx, p)
        with pytest.raises(error):
            tx.check()


def test_savepoints_and_commit(make, tmp_path):
    tx, p = make()
    tx.delete(p, p.id.eq(10))
    one = tx.savepoint()
    tx.delete(p, p.id.eq(11))
    two = tx.savepoint()
    tx.delete(p, ALL_ROWS)
    tx.rollback_to(two)
    assert len(rows(tx, p)) == 2
    tx.rollback_to(one)
    assert len(rows(tx, p)) == 3
    db = tx.commit(str(tmp_path))
    assert db.select(p).count() == 3 and rows(tx, p) != [] and not tx.staged
    with pytest.raises(RuntimeError), Changes(db) as failed:
        failed.delete(p, ALL_ROWS)
        raise RuntimeError
    assert not failed.staged


def test_many_to_many(spark):
    post, tag, tie = Model("p", {"id": "bigint"}), Model("t", {"id": "bigint"}), Model("pt", {"post": "bigint", "tag": "bigint"}, ("post", "tag"))
    tags = Relation("tags", "t", "id", "id", through=("pt", "post", "tag"))
    tx = Changes(Db(spark, [post, tag, tie], tables={"pt": spark.createDataFrame([(1, 10), (1, 20), (2, 20)], tie.schema)}))
    tx.attach(tags, 1, [20, 30])
    assert rows(tx, tie) == [(1, 10), (1, 20), (1, 30), (2, 20)]
    tx.set_related(tags, 1, [10])
    assert rows(tx, tie) == [(1, 10), (2, 20)]
    tx.detach(tags, 1)
    assert rows(tx, tie) == [(2, 20)]


def test_one_to_many(make):
    tx, p = make()
    theirs = Relation("posts", "posts", "author", "id")
    tx.set_related(theirs, 2, [10, 13])
    assert rows(tx, p) == [(10, 2), (11, 1), (12, None), (13, 2)]
    tx.set_related(theirs, 1, [])
    assert rows(tx, p) == [(10, 2), (11, None), (12, None), (13, 2)]


def test_raw_statements(make):
    tx, p = make()
    tx.delete(p, p.id.eq(10))
    assert tx.fetch_one("SELECT count(*) AS n FROM posts WHERE author = ?", [1]).n == 1
    assert tx.fetch_optional("SELECT * FROM posts WHERE id = 10") is None and len(tx.fetch_all("SELECT * FROM posts")) == 3
    with pytest.raises(NoRow):
        tx.fetch_one("SELECT * FROM posts WHERE id = 10")
    assert tx.execute(p, "SELECT id, CAST(2 AS BIGINT) AS author FROM posts WHERE id <> :id", {"id": 13}).count() == 3
    assert rows(tx, p) == [(11, 2), (12, 2)]


def test_names_in_raw_sql(spark, tmp_path):
    part, spend = Model("part", {"id": "bigint"}), Model("spend", {"spend": "bigint"}, ("spend",))
    db = Db(spark, [part, spend], str(tmp_path), {"spend": spark.createDataFrame([(1,), (2,)], spend.schema)})
    spark.range(5).createOrReplaceTempView("spend")
    # no table part is stored, and none is named; the session's own view comes back
    assert db.sql("SELECT spend AS departures, 'part' AS word FROM spend WHERE spend > 1").collect() == [(2, "part")]
    assert spark.table("spend").count() == 5
    spark.catalog.dropTempView("spend")


def test_stored_declaration(make, tmp_path):
    tx, p = make()
    tx.insert(users, [{"name": "c"}])
    tx.update(p, p.id.eq(13), author=2)
    db = tx.commit(str(tmp_path))
    for m in (users, p):
        read = model_of(m.name, db.spark.read.parquet(str(next((tmp_path / m.name).iterdir()))))
        assert (read.columns, tuple(read.key), [tuple(u) for u in read.unique], tuple(read.foreign)) == (m.columns, tuple(m.key), [tuple(u) for u in m.unique], tuple(m.foreign))


def test_declarations_are_checked():
    with pytest.raises(ValueError, match="nullable"):
        Model("m", {"id": "bigint", "up": "bigint"}, foreign=(ForeignKey("up", "m", "id", "set_null"),))
    with pytest.raises(ValueError, match="on_delete"):
        Model("m", {"id": "bigint", "up": "bigint?"}, foreign=(ForeignKey("up", "m", "id", "explode"),))
    a = Model("a", {"id": "bigint", "b": "int?"}, foreign=(ForeignKey("b", "bb", "id"),), relations={"bs": Relation("bs", "b", "aa", "id")})
    b = Model("b", {"id": "bigint", "a": "int?"}, foreign=(ForeignKey("a", "a", "id"),))
    assert validate([a, b]) == ["a.b: no model 'bb', did you mean 'b'?", "a.bs: b has no column 'aa', did you mean 'a'?", "b.a is int, a.id is bigint"]


def test_rules_and_plans():
    old = Model("m", {"id": "bigint", "a": "string?", "p": "bigint?"}, unique=(("a",),), foreign=(ForeignKey("p", "q", "id"),), allowed={"a": ("x",)})
    new = Model("m", {"id": "bigint", "b": "string?", "p": "bigint?"}, ("id", "b"), unique=(("p",),), foreign=(ForeignKey("p", "q", "id", "cascade"),), defaults={"b": "'x'"})
    changes = diff(old, new, {"b": "a"})
    assert [(c.kind, c.column) for c in changes] == [("rename", "b"), ("not_unique", "b"), ("not_foreign", "p"), ("key", "id, b"), ("unique", "p"), ("foreign", "p"), ("allowed", "b"), ("default", "b")]
    assert [c.kind for c in reverse(changes)] == ["default", "allowed", "not_foreign", "not_unique", "key", "foreign", "unique", "rename"]
    q = Model("q", {"id": "bigint", "m": "bigint?"}, foreign=(ForeignKey("m", "m", "id"),))
    r = Model("r", {"id": "bigint", "q": "bigint?"}, foreign=(ForeignKey("q", "q", "id"),))
    steps = plan([Model("gone", {"id": "bigint"})], [r, q, old])
    assert [(n, c.kind) for n, c in steps] == [("m", "create"), ("q", "create"), ("q", "foreign"), ("r", "create"), ("r", "foreign"), ("m", "foreign"), ("gone", "remove")]


def test_seed(make):
    tx, _ = make()
    text = '{"users": [{"id": 1, "name": "new"}, {"id": 7, "name": "seven", "role": "admin"}]}'
    apply_seed(tx, text)
    once = rows(tx, users)
    apply_seed(tx, text)
    assert rows(tx, users) == once and (1, "new", "admin") in once
    with pytest.raises(ValueError):
        apply_seed(tx, '{"users": [{"name": "no key"}]}')


def test_migrations(spark):
    old = Model("m", {"id": "bigint", "nmae": "string?", "n": "int", "gone": "string?"})
    new = Model("m", {"id": "bigint", "name": "string?", "n": "bigint", "level": "int"})
    assert diff(old, old) == [] and rename_hints(old, new) == [("nmae", "name")]
    changes = diff(old, new, {"name": "nmae"})
    assert changes == [Change("rename", "name", "nmae", "name"), Change("drop", "gone", "string?"), Change("retype", "n", "int", "bigint"), Change("add", "level", None, "int")]
    df = spark.createDataFrame([(1, "a", 2, "x")], old.schema)
    with pytest.raises(MigrationError):
        apply(df, changes, {"level": 1})
    with pytest.raises(MigrationError):
        apply(df, changes, accept_data_loss=True)
    out = apply(df, changes, {"level": 1}, accept_data_loss=True).select(*new.columns)
    assert out.collect() == [(1, "a", 2, 1)] and drift(new, out) == []
    back = apply(out, reverse(changes), accept_data_loss=True).select(*old.columns)
    assert back.collect() == [(1, "a", 2, None)]
    assert drift(new, df) == ["missing column name", "missing column level", "unknown column nmae", "unknown column gone", "n is int, not bigint"]
    holes = spark.createDataFrame([(1, None, None, 1), (2, "a", None, 1)], "id long, name string, n long, level int")
    assert drift(new, holes) == ["n is required and null in 2 rows"]
    assert model_of("m", df, ("id",)).columns == {"id": "bigint", "nmae": "string?", "n": "int", "gone": "string?"}
    assert old.fingerprint() != new.fingerprint()


def test_stream(spark, tmp_path):
    events = Model("events", {"id": "bigint", "kind": "string?"})
    spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], events.schema).write.parquet(str(tmp_path / "in"))
    db = streamed(Db(spark, [events]), events, str(tmp_path / "in"))
    start(db.select(events).filter(events.kind.eq("a")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
