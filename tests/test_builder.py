"""Semantics of the builder on small tables, by hand-computed rows."""

from datetime import date

import pytest

from tessella.functions.predicates import Param, all_of, any_of, raw
from tessella.operators.include import Include, every, none, some
from tessella.plans.actions import counted
from tessella.plans.select import METRICS, NoRow
from tessella.schema import Model, Relation
from tessella.session import Db

items = Model("items", {"id": "bigint", "handle": "string", "age": "bigint", "active": "bigint", "note": "string?"})
employees = Model("employees", {"id": "bigint", "role": "string", "age": "bigint", "salary": "double"})
users = Model("users", {"id": "bigint", "name": "string?"})
posts = Model("posts", {"id": "bigint", "title": "string?", "author": "bigint?"})
docs = Model("docs", {"id": "bigint", "meta": "string?"})
likes = Model("likes", {"user": "bigint?", "post": "bigint"}, ("post", "user"))
POSTS = Relation("posts", "posts", "author", "id")
LIKED = Relation("liked", "posts", "id", "id", through=("likes", "user", "post"))


@pytest.fixture(scope="module")
def db(spark):
    frame = spark.createDataFrame
    return Db(
        spark,
        [items, employees, users, posts, docs],
        tables={
            "items": frame([(1, "alpha", 10, 1, None), (2, "beta", 20, 0, "first"), (3, "gamma", 30, 1, None), (4, "delta", 40, 1, "second"), (5, "epsilon", 25, 0, None)], items.schema),
            "employees": frame([(1, "Engineer", 30, 1e5), (2, "Engineer", 35, 1.2e5), (3, "Manager", 45, 1.5e5), (4, "Manager", 50, 1.8e5)], employees.schema),
            "users": frame([(1, "Ann"), (2, "Bo"), (3, None)], users.schema),
            "posts": frame([(10, "x", 1), (11, None, 1), (12, "y", 2), (13, "z", None)], posts.schema),
            "docs": frame([(1, '{"a": {"b": 5}, "t": ["x", "y"], "n": null, "f": true}'), (2, '{"a": {"b": 50}, "t": []}'), (3, '[{"k d": "v"}]'), (4, None), (5, '{"it\'s": {"why?": 3, "s": "xAby"}}')], docs.schema),
        },
    )


def ids(query):
    return sorted(r.id for r in query.fetch_all())


def where(db, f):
    return ids(db.select(items).filter(f))


def test_predicates(db):
    assert where(db, items.age.gt(15) & items.age.lt(35)) == [2, 3, 5]
    assert where(db, items.age.between(20, 30)) == [2, 3, 5]
    assert where(db, items.handle.in_(["alpha", "gamma", "epsilon"])) == [1, 3, 5]
    assert where(db, items.handle.not_in(["alpha", "gamma"])) == [2, 4, 5]
    assert where(db, items.handle.starts_with("e")) == [5]
    assert where(db, items.handle.ends_with("ma")) == [3]
    assert where(db, items.handle.contains("_lt")) == [4]
    assert where(db, items.handle.contains("\\")) == []
    assert where(db, items.note.is_null()) == [1, 3, 5] == where(db, items.note.eq(None))
    assert where(db, items.note.ne("first")) == [4]
    assert where(db, all_of([items.active.eq(1), items.age.gt(15), items.age.lt(35)])) == [3]
    assert where(db, any_of([items.age.eq(a) for a in (10, 30, 50)])) == [1, 3]
    assert where(db, all_of([])) == [1, 2, 3, 4, 5] and where(db, any_of([])) == []
    assert where(db, raw("handle = {} OR age = {}", "it's \\ odd", 40)) == [4]


def test_types(db):
    for wrong in (
        lambda: items.age.eq("x"), lambda: items.age.gt(True), lambda: items.id.is_null(), lambda: items.age.contains("1"), lambda: items.handle.sum(),
        lambda: db.select(items).filter(users.id.eq(1)), lambda: db.select(items).columns(users.id), lambda: bool(items.id.eq(1)), lambda: items.age.contains_all([1]),
    ):
        with pytest.raises(TypeError):
            wrong()
    with pytest.raises(AttributeError, match="did you mean 'handle'"):
        items.handel  # noqa: B018
    with pytest.raises(ValueError, match="no column"):
        Model("m", {"id": "bigint"}, ("idd",))


def test_shapes(db):
    page = db.select(items).order_by(items.age.asc()).page(2)
    assert [r.age for r in page.items] == [10, 20] and page.has_next
    assert not db.select(items).page(5).has_next and not db.select(items).page(10).has_next
    assert [r.age for r in db.select(items).order_by(items.age.asc()).offset(2).limit(2).fetch_all()] == [25, 30]
    assert [r.id for r in db.select(items).after(items.id, 2, 2).fetch_all()] == [3, 4]
    assert [r.id for r in db.select(items).before(items.id, 5, 2).fetch_all()] == [4, 3]
    assert len(db.select(items).columns(items.active).distinct().fetch_all()) == 2
    assert db.select(items).filter(items.active.eq(1)).limit(1).count() == 3
    assert db.select(items).filter(items.age.eq(40)).exists() and not db.select(items).filter(items.age.eq(41)).exists()
    assert db.select(items).filter(items.id.eq(9)).fetch_optional() is None
    with pytest.raises(NoRow):
        db.select(items).filter(items.id.eq(9)).fetch_one()
    assert sorted(r.id for r in db.select(items).stream_unbuffered()) == [1, 2, 3, 4, 5]
    assert [r.id for r in db.select(items).order_by(items.note.asc(), items.id.asc()).stream()] == [2, 4, 1, 3, 5]
    assert [r.id for r in db.select(items).order_by(items.note.desc(), items.id.asc()).stream()] == [1, 3, 5, 4, 2]


def test_aggregates(db):
    e = employees
    row = db.select(e).aggregate(e.salary.sum(), e.id.count(), e.age.avg(), e.role.count_distinct()).fetch_one()
    assert row.asDict() == {"sum_salary": 550000.0, "count_id": 4, "avg_age": 40.0, "count_distinct_role": 2}
    by_role = db.select(e).group_by(e.role).aggregate(e.salary.sum(), e.id.count()).order_by(e.role.asc())
    assert [tuple(r) for r in by_role.fetch_all()] == [(220000.0, 2), (330000.0, 2)]
    assert [tuple(r) for r in by_role.having(e.role.eq("Manager")).fetch_all()] == [(330000.0, 2)]
    assert [tuple(r) for r in by_role.filter(e.age.gt(35)).fetch_all()] == [(330000.0, 2)]


def test_conditional_filters_of_aggregates(db):
    e = employees
    by_role = db.select(e).group_by(e.role).aggregate(e.id.count()).order_by(e.role.asc())
    counts = lambda q: [r.count_id for r in q.fetch_all()]
    assert counts(by_role.filter_if(None, e.age.gt)) == [2, 2] and counts(by_role.filter_if(40, e.age.gt)) == [2]
    assert counts(by_role.filter(e.age.gt(46)).or_filter_if(31, e.age.lt)) == [1, 1]
    assert counts(by_role.having(e.role.eq("Manager")).or_having_if("Engineer", e.role.eq)) == [2, 2]
    assert counts(by_role.having(e.role.eq("Manager")).or_having_if(None, e.role.eq)) == [2]


def test_prepared_builder(db):
    query = db.select(items).filter(items.age.between(Param(0), Param(1)) & items.active.eq(Param(2))).order_by(items.id.asc()).prepare()
    assert [r.id for r in query.bind_many([0, 30, 1]).fetch_all()] == [1, 3]
    assert [r.id for r in query.bind(1, 100).fetch_all()] == [1, 3, 4]
    assert [r.id for r in query.bind(2, 0).bind(9, "ignored").fetch_all()] == [2, 5]
    with pytest.raises(ValueError, match="parameter 0"):
        db.select(items).filter(items.age.eq(Param(0))).fetch_all()


def test_combined_fetches(db):
    some, more = db.select(items).filter(items.id.lte(2)).columns(items.id), db.select(items).filter(items.id.gte(2)).columns(items.id)
    assert ids(some.union(more)) == [1, 2, 3, 4, 5] and ids(some.union_all(more)) == [1, 2, 2, 3, 4, 5]
    assert ids(some.intersect(more)) == [2] and ids(some.except_(more)) == [1]
    assert len(some.union(more).limit(3).fetch_all()) == 3 and len(some.union(more).offset(4).fetch_all()) == 1 and some.intersect(more).fetch_one().id == 2
    assert sorted(r.id for r in some.union(more).stream()) == [1, 2, 3, 4, 5] == sorted(r.id for r in some.union(more).stream_unbuffered())
    with pytest.raises(TypeError):
        some.union(db.select(items)).fetch_all()


def test_actions_are_counted_when_spark_drops_old_ones(spark):
    one = spark.sql("VALUES (1)")
    for _ in range(int(spark.conf.get("spark.sql.ui.retainedExecutions"))):
        one.collect()
    with counted(spark) as n:
        spark.range(3).count()
        spark.range(3).collect()
    assert n.actions == 2


def test_one_action_to_a_fetch(spark, db):
    tree = db.select(users).filter(users.id.lt(3)).include(Include(POSTS))
    with counted(spark) as n:
        assert sorted(len(r.posts) for r in tree.fetch_all()) == [1, 2]
        assert tree.order_by(users.id.asc()).fetch_one().id == 1
    assert n.actions == 2
    before = METRICS.fetches, METRICS.rows, METRICS.slow
    METRICS.slow_after, was = 0.0, METRICS.slow_after
    db.select(users).fetch_all()
    METRICS.slow_after = was
    assert (METRICS.fetches, METRICS.rows, METRICS.slow) == (before[0] + 1, before[1] + 3, before[2] + 1)


def test_related(spark, db):
    writer = Model("users", {"id": "bigint", "name": "string?"}, relations={"posts": POSTS, "liked": LIKED})
    wide = Db(spark, [writer, posts, likes], tables=db.tables | {"likes": spark.createDataFrame([(1, 10), (1, 13), (2, 12), (None, 10)], likes.schema)})
    assert ids(wide.related(wide.relation("users", "posts"), 1).filter(posts.title.is_null())) == [11]
    assert [r.id for r in wide.related(writer.relation("liked"), 1).order_by(posts.id.desc()).fetch_all()] == [13, 10]
    assert ids(wide.select(writer).filter(some(writer, writer.relation("liked"), posts.title.eq("y")))) == [2]
    with pytest.raises(AttributeError, match="did you mean 'posts'"):
        writer.relation("post")


def test_joins(db):
    rows = db.select(users).left_join(posts, users.id.on(posts.author)).to_df().orderBy("left.id", "right.id").collect()
    assert [(r.left.id, r.right and r.right.id) for r in rows] == [(1, 10), (1, 11), (2, 12), (3, None)]
    rows = db.select(users).full_join(posts, users.id.on(posts.author)).to_df().collect()
    assert sum(r.left is None for r in rows) == 1 and sum(r.right is None for r in rows) == 1
    with pytest.raises(ValueError):
        db.select(users).inner_join(users, users.id.on(users.id))
    next_one = users.id.compare("<", users.id.aliased("later"))
    pairs = lambda q: sorted(((r.left and r.left.id, r.right and r.right.id) for r in q.to_df().collect()), key=str)
    assert pairs(db.select(users).right_join(users, next_one, "later")) == [(1, 2), (1, 3), (2, 3), (None, 1)]
    assert pairs(db.select(users).full_join(users, next_one, "later")) == [(1, 2), (1, 3), (2, 3), (3, None), (None, 1)]


def test_relations(db):
    rows = {r.id: r for r in db.select(users).include(Include(POSTS).order_by(posts.id.desc()).take(1)).fetch_all()}
    assert [p.id for p in rows[1].posts] == [11] and rows[3].posts == []
    named = posts.title.eq("x")
    assert ids(db.select(users).filter(some(users, POSTS, named))) == [1]
    assert ids(db.select(users).filter(none(users, POSTS, named))) == [2, 3]
    assert ids(db.select(users).filter(every(users, POSTS, named))) == [1, 3]  # a null title doesn't fail
    assert ids(db.select(posts).filter(posts.author.not_in(db.select(users).columns(users.id)))) == []


def test_json(db):
    d = docs
    assert ids(db.select(d).filter(d.meta.get("a").get("b").gt(10))) == [2]
    assert ids(db.select(d).filter(d.meta.at(0).get_text("k d").eq("v"))) == [3]
    assert ids(db.select(d).filter(d.meta.has_key("n"))) == [1]
    assert ids(db.select(d).filter(d.meta.json_contains({"a": {"b": 5}, "t": ["y"], "f": True, "n": None}))) == [1]
    assert ids(db.select(d).filter(d.meta.json_contains({"t": []}))) == [1, 2]
    assert ids(db.select(d).filter(d.meta.get("it's").get("why?").gte(3) & d.meta.get("it's").get_text("s").ilike("aB"))) == [5]
    assert ids(db.select(d).filter(d.meta.json_contains({"it's": {"why?": 3}}))) == [5] and ids(db.select(d).filter(d.meta.has_key("it's"))) == [5]


def test_dates(spark):
    m = Model("m", {"id": "bigint", "d": "date"})
    db = Db(spark, [m], tables={"m": spark.createDataFrame([(1, date(2020, 1, 1)), (2, date(2021, 1, 1))], m.schema)})
    assert ids(db.select(m).filter(m.d.gt(date(2020, 6, 1)))) == [2] == ids(db.select(m).filter(raw("d > {}", date(2020, 6, 1))))
