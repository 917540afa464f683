import copy
import json

import pytest
from pyspark.sql import functions as F

from trailmart.functions import traces
from trailmart.operators import conversations as conv
from trailmart.operators import verification as ver
from trailmart.sources.files import MESSAGE

STATE = 'shown\n\n搜索功能是否可用: {}\n\n可点击的按钮: {}'


def state(search, buttons):
    return STATE.format(search, json.dumps(buttons, ensure_ascii=False))


def call(i, name, arguments):
    return {"role": "assistant", "content": "", "tool_calls": [{"id": f"c{i}", "type": "function", "function": {"name": name, "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)}}]}


def tool(i, content):
    return {"role": "tool", "tool_call_id": f"c{i}", "content": content}


def good():
    return [
        {"role": "system", "content": "prompt"}, {"role": "user", "content": "Instruction: 买 Ａ杯" + state("True", [])}, call(0, "search", {"keywords": "杯"}), tool(0, state("False", ["1/23", "Back"])),
        call(1, "click", {"value": " １/23 "}), tool(1, state("False", ["Buy", "back"])), call(2, "click", {"value": "buy"}), tool(2, "Reward Details [SEP] 1"),
    ]


def changed(f):
    m = copy.deepcopy(good())
    f(m)
    return m


def set_args(i, value):
    return lambda m: m[i]["tool_calls"][0]["function"].update(arguments=value)


CASES = {
    (): lambda m: None,
    ("click_not_available",): set_args(4, '{"value":"1|23"}'),
    ("search_when_unavailable",): lambda m: m[4]["tool_calls"][0].update(function={"name": "search", "arguments": '{"keywords":"again"}'}),
    ("invalid_tool_arguments", ""): set_args(2, "{"),
    ("invalid_tool_arguments",): set_args(2, '["a"]'),
    ("invalid_tool_arguments", " "): set_args(2, '{"keywords": "a"} b'),
    ("missing_required_tool_argument",): set_args(2, '{"keywords": 5}'),
    ("missing_required_tool_argument", ""): set_args(2, '{"value": "x"}'),
    ("missing_tool_response", "invalid_conversation_role_sequence", "missing_preceding_state", "unparseable_state_controls"): lambda m: m.pop(3),
    ("tool_call_id_mismatch",): lambda m: m[3].update(tool_call_id="other"),
    ("missing_tool_call_id", "tool_call_id_mismatch"): lambda m: m[2]["tool_calls"][0].update(id=None),
    ("duplicate_tool_call_id", "tool_call_id_mismatch"): lambda m: m[4]["tool_calls"][0].update(id="c0"),
    ("unsupported_tool",): lambda m: m[4]["tool_calls"][0]["function"].update(name="buy"),
    ("assistant_not_exactly_one_tool",): lambda m: m[4].update(tool_calls=[]),
    ("unparseable_state_controls",): lambda m: m[3].update(content="可点击的按钮: [1]"),
    ("repeated_state_action_loop",): lambda m: (m[5].update(content=m[3]["content"]), m[6]["tool_calls"][0].update(function=copy.deepcopy(m[4]["tool_calls"][0]["function"]))),
    ("privileged_label_leak",): lambda m: m[0].update(content='{"goal_options":["红"]}'),
    ("privileged_observation_leak",): lambda m: m[3].update(content="Reward Details [SEP]\n" + m[3]["content"]),
    ("invalid_conversation_role_sequence", "not_single_turn_conversation", "privileged_observation_leak"): lambda m: m.insert(8, {"role": "user", "content": "x"}),
    ("missing_conversation", "invalid_conversation_role_sequence", "not_single_turn_conversation", "no_actions"): lambda m: m.clear(),
}


@pytest.fixture(scope="module")
def trajectories(spark):
    rows = [(i, json.dumps(changed(f), ensure_ascii=False)) for i, f in enumerate(CASES.values())]
    return spark.createDataFrame(rows, "task_id long, j string").select("task_id", F.from_json("j", f"array<{MESSAGE}>").alias("conversation")).cache()


def test_each_reason(trajectories):
    got = {r.task_id: set(r.reasons) for r in ver.verify_messages(trajectories, "task_id").collect()}
    for i, wanted in enumerate(CASES):
        assert got[i] == {w for w in wanted if w.strip()}, (wanted, got[i])


def test_metrics_hashes_and_nulls(spark, trajectories):
    one = trajectories.filter("task_id = 0")
    r = ver.verify_messages(one, "task_id", prompt_hash="x", instruction_hash=F.lit("y")).first()
    assert set(r.reasons) == {"system_prompt_mismatch", "instruction_task_mismatch"} and (r.num_tool_calls, r.repeated_action_count) == (3, 0)
    wanted = spark.range(1).select(F.sha2(F.lit("买a杯shown"), 256)).first()[0]
    from trailmart.functions.text import nfkc_casefold

    assert one.select(traces.instruction_hash(F.get("conversation", F.lit(1))["content"], nfkc_casefold)).first()[0] == wanted
    none = one.select("task_id", F.lit(None).cast(one.schema["conversation"].dataType).alias("conversation"))
    assert "missing_conversation" in ver.verify_messages(none, "task_id").first().reasons
    assert ver.verify_messages(one.limit(0), "task_id").count() == 0
    s = ver.action_statistics(one, "task_id").first()
    assert (s.searches, s.clicks, s.distinct_actions, s.repeated) == (1, 2, 3, 0)


ROW = "task_id long, reward double, reward_detail struct<r_att double, r_option double, r_price double, r_type double>, goal struct<asin string, goal_options array<string>>, purchase struct<asin string, options map<string,string>>"
DIAG = ROW.replace("goal struct", "goal_summary struct").replace("purchase struct", "purchase_summary struct") + ", termination_reason string, completed_purchase boolean, thinking string, model_name string, run_name string, invalid_tool_response_count int, tool_errors array<string>"


def test_outcome_identity_diagnostics(spark):
    detail, goal, bought = (1.0, 1.0, 1.0, 1.0), ("a", ["【?质保十年】亮银/双折"]), ("a", {"颜色": "【⭐质保十年】亮银 | 双折"})
    diag = (1500, 1.0, detail, goal, bought, "purchase", True, "enabled", "m", "r", 0, [])
    rows = [
        ((1500, 1.0, detail, goal, bought), diag, set(), set()), ((9, 0.5, (1.0, None, 1.0, 1.0), goal, ("b", {"c": "蓝"})), None, {"task_not_in_train_range", "reward_not_one", "r_option_not_full", "asin_mismatch", "exact_options_mismatch"}, None),
        ((1501, 1.0, detail, goal, None), (1500, 0.0, detail, ("z", None), None, "timeout", False, None, "m", "r", 2, ["e"]), {"asin_mismatch", "exact_options_mismatch"},
         {"diagnostics_task_id_mismatch", "diagnostics_reward_mismatch", "diagnostics_goal_mismatch", "missing_diagnostics_purchase", "not_completed_by_purchase", "teacher_thinking_not_enabled", "hidden_tool_retry", "tool_error"}),
    ]
    df = spark.createDataFrame([(i, t, d) for i, (t, d, *_) in enumerate(rows)], f"i int, t struct<{ROW}>, d struct<{DIAG}>")
    t = F.col("t")
    got = df.select("i", F.concat(ver.identity(t["task_id"], 1459, 23421), ver.outcome(t["reward"], t["reward_detail"], t["goal"], t["purchase"])).alias("o"), ver.diagnostics(t, F.col("d")).alias("g")).collect()
    for r in got:
        assert set(r.o) == rows[r.i][2], (r.i, r.o)
        if rows[r.i][3] is None:
            assert {"missing_diagnostics", "missing_diagnostics_goal", "diagnostics_reward_mismatch"} <= set(r.g)
        else:
            assert set(r.g) == rows[r.i][3], (r.i, r.g)


def test_export_and_checks(spark, trajectories):
    one = trajectories.filter("task_id = 0").select("task_id", F.transform("conversation", lambda m: m.withField("reasoning_content", F.when(m["role"] == "assistant", "why"))).alias("conversation"))
    sample = json.loads(conv.export_samples(one, "task_id", '[{"type": "function"}]').first().sample)
    assert set(sample) == {"messages", "tools"} and sample["tools"] == [{"type": "function"}]
    assert sample["messages"][2]["tool_calls"][0]["function"]["arguments"] == {"keywords": "杯"} and sample["messages"][2]["content"] == "" and "reasoning_content" not in sample["messages"][2]
    assert sample["messages"][-1]["content"] == "" and sample["messages"][3]["tool_call_id"] == "c0"
    kept = conv.export_samples(one, "task_id", reasoning=True)
    assert json.loads(kept.first().sample)["messages"][2]["reasoning_content"] == "why"
    assert conv.sample_errors(kept, "task_id").first().errors == ["reasoning_leak"] and conv.sample_errors(kept, "task_id", True).first().errors == []
    fine = conv.export_samples(one, "task_id")
    assert conv.sample_errors(fine, "task_id").first().errors == [] and tuple(conv.sample_counts(fine).first()) == (1, 3)
    bad = [
        ('{"messages": [], "tools": [], "x": 1}', {"keys", "no_messages"}), ("no json", {"keys", "no_messages"}),
        ('{"tools": [], "messages": [{"role": "tool", "content": "Target [SEP] asin"}, {"role": "assistant", "content": "<think>", "tool_calls": []}]}', {"result_leak", "not_one_call", "arguments_no_object", "assistant_text", "reasoning_leak"}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(bad)], "i int, sample string")
    for r in conv.sample_errors(df, "i").collect():
        assert set(r.errors) == bad[r.i][1], (r.i, r.errors)
    assert one.select(conv.action_only_errors(F.col("conversation"))).first()[0] == ["reasoning"]
    block = "Think first.\n"
    chats = spark.createDataFrame([(1, [("system", "a " + block), ("user", "u")]), (2, [("system", block * 2)]), (3, [("user", "u")])], "i int, messages array<struct<role string, content string>>")
    cleaned, broken = conv.without_block(chats, block)
    assert [(r.i, r.messages[0].content) for r in cleaned.collect()] == [(1, "a\n")] and sorted(r.i for r in broken.collect()) == [2, 3]


def test_parsers(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    lit = F.lit
    assert one(traces.action_name(lit("back"))) == "back"
    assert one(traces.action_name(lit("search[a b]"))) == "search" and one(traces.action_argument(lit("search[a b]"))) == "a b" and one(traces.action_argument(lit("back"))) is None
    text = state("True", ["a"]) + "\n" + state("false", ["b", 'c"d'])
    assert one(traces.search_available(lit(text))) is False and one(traces.clickables(lit(text))) == ["b", 'c"d'] and one(traces.clickables(lit("可点击的按钮: [1]"))) is None
    assert one(traces.without_controls(lit("Instruction: 买" + state("True", [])))).startswith("买shown")
    assert one(traces.observation(lit("Instruction: [SEP] wish [SEP] page [SEP] x"))) == "[SEP] page [SEP] x" and one(traces.observation(lit("page"))) == "page"
    assert one(traces.answered_action(lit("Thought\nAction: click[x]"))) == "click[x]" and one(traces.answered_action(lit("click[x]"))) == "click[x]"
    assert one(traces.control_block(lit(True), F.array(lit("search"), lit('a"b')))) == '\n\n搜索功能是否可用: True\n\n可点击的按钮: ["a\\"b"]'
    assert one(traces.bare_text(lit(' "A\'b" [SEP] '))) == "ab [SEP]" and one(traces.goal_text(lit("WebShop\nInstruction: Red shoe, and price lower than 5"))) == "red shoe"
    assert one(traces.signature(lit("click"), lit('{"b": 1, "a": "x"}'))) == one(traces.signature(lit("click"), lit('{"a":"x","b":1}')))
    assert one(traces.compact_length(lit('{"a": [1, 2]}'))) == 11 and one(traces.compact_length(lit("{"))) is None
    assert one(traces.search_available(lit(None).cast("string"))) is None and one(traces.clickables(lit(""))) is None


def test_chats_and_traces(spark):
    docs = spark.createDataFrame([(1, "hello\n用户：a\nb\n\n客服：c\n"), (2, "no roles"), (3, None), (4, "Agent: x"), (5, "")], "i int, text string")
    got = {r.i: [(m.role, m.content) for m in r.messages] for r in conv.from_chat(docs, "i", "text").collect()}
    assert got == {1: [("user", "a\nb\n"), ("assistant", "c")], 4: [("assistant", "x")]}
    logs = spark.createDataFrame([(1, 'Instruction: x\nsearch[red cup] returned 3\n可点击的按钮: ["a"]\nclick[a] changed\n搜索“杯”返回2条\nend'), (2, "nothing"), (3, None)], "i int, text string")
    (row,) = conv.from_trace(logs, "i", "text").collect()
    m = row.conversation
    assert [x.role for x in m] == ["system", "user"] + ["assistant", "tool"] * 3 and [x.content for x in m if x.role != "assistant"] == ["", "Instruction: x", '可点击的按钮: ["a"]', "", "end"]
    assert json.loads(m[2].tool_calls[0].function.arguments) == {"keywords": "red cup"} and m[6].tool_calls[0].function.name == "search" and m[3].tool_call_id == m[2].tool_calls[0].id
