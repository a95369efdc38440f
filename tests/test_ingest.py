from graphloom.operators import ingest as I
from graphloom.operators.retrieval import merge_steps


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_chunks(spark):
    got = I.chunk_documents(docs(spark, "short\n\n" + "x" * 3500 + "\n\ntail", "  \n\n ")).orderBy("doc_id", "chunk_idx").collect()
    assert [len(r.chunk) for r in got] == [5, 3000, 500, 4]
    two = I.chunk_sentences(docs(spark, "a" * 1000 + "。" + "b" * 1300 + "。" + "c" * 10 + "\n\nend")).orderBy("chunk_idx").collect()
    assert [len(r.chunk) for r in two] == [1001, 1316]
    assert two[1].chunk.endswith("c\n\nend")


def test_json_repair(spark):
    texts = ['```json\n{"a":1}\n```', 'x {"a":[1,],} y', "nothing", "", '{"a":1} {"b":2}']
    got = [r.json for r in I.parse_model_json(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).orderBy("i").collect()]
    assert got == ['{"a":1}', '{"a":[1]}', None, None, None]


def test_normalize_and_match(spark, make):
    g = make(["郑和"], [], aliases=[("郑和", "三宝太监")])
    body = ('{"entities":[{"name":" 三宝太监 ","category":"?","aliases":[" 马和 ",3]},{"name":"明朝","aliases":["大明"]},{"name":"大明"},{"name":""}],'
            '"relations":[{"from":"三宝太监","to":"大明","name":"属于","confidence":"x"},{"from":"明朝","to":"天涯","name":"在"},{"from":"","to":"a","name":"b"}]}')
    parsed = spark.createDataFrame([(1, 2, "古籍.md", body)], "doc_id long, chunk_idx int, filename string, json string")
    e, r = I.normalize_candidates(parsed)
    assert [(x.name, x.category, list(x.aliases)) for x in e.orderBy("pos").collect()] == [
        ("三宝太监", "抽象实体", ["马和"]), ("明朝", "抽象实体", ["大明"]), ("大明", "抽象实体", [])]
    assert {(x.confidence, x.category, x.source_ref) for x in r.collect()} == {("推测", "属性", "《古籍.md》片段3")}
    me, mr = I.match_candidates(g, I.merge_candidate_entities(e), I.dedup_candidate_relations(r))
    rows = {x.name: x for x in me.collect()}
    assert rows["三宝太监"].existing_id == 1 and rows["大明"].dupe_of_candidate and rows["明朝"].existing_id is None
    assert {(x["from"], x.unresolved) for x in mr.collect()} == {("三宝太监", False), ("明朝", True)}
    out, counts, error = I.commit_candidates(g, me, mr)
    c = counts.first()
    assert error is None and (c.entities_added, c.entities_linked, c.relations_added, c.relations_skipped) == (1, 1, 1, 0)
    assert {(a.entity_id, a.alias) for a in out.aliases.collect()} == {(1, "三宝太监"), (2, "大明"), (1, "马和")}


def test_ops_blocks_and_lines(spark):
    text = 'hi ```kg-ops\n[{"op":"add_entity","name":"x"}]\n``` there ```kg-ops {bad```'
    rows, replies = I.parse_ops_blocks(spark.createDataFrame([(1, text)], "msg_id long, text string"))
    assert [(r.op, r.name) for r in rows.collect()] == [("add_entity", "x")]
    reply = replies.first()
    assert reply.reply == "hi  there" and reply.parse_error


def test_plans(spark):
    texts = ['{"steps":[{"tool":"ego","center":"x","depth":99}]}', '{"steps":[{"tool":"keyword","q":"a"}]}', '{"steps":[]}', "null"]
    got = [r.ok for r in I.validate_plans(spark.createDataFrame(list(enumerate(texts)), "qid long, text string")).orderBy("qid").collect()]
    assert got == [False, True, False, False]


def test_merge_steps_keeps_first(spark):
    df = spark.createDataFrame([(1, 0, 5, 10), (1, 1, 0, 11), (1, 1, 1, 10)], "qid long, step int, pos long, id long")
    assert [(r.id, r.pos) for r in merge_steps(df, "id").orderBy("pos").collect()] == [(10, 0), (11, 1)]
