import random
import unicodedata

import pytest

from conftest import rows
from trailmart.llm import abuse, bpe, lookalikes, packing
from trailmart.llm.instructions import canonical


@pytest.fixture(scope="module")
def encoders():
    if not __import__("os").path.isdir(bpe.VOCABULARY_DIR):
        pytest.skip("no vocabulary files here")
    return {n: bpe.encoder(bpe.VOCABULARY_DIR, n) for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}


def reference(name, own):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.word_pattern(bpe.VOCABULARY_DIR), mergeable_ranks=own.rank, special_tokens={})


def test_encoding_equals_the_public_library(encoders):
    r = random.Random(1)
    texts = ["", None, " ", "<|endoftext|> text", "茶" * 3000, "a" * 5000, " " * 700, "x\n\n\ny", "it's I'D we'll", "😀👩‍👧𠮷 é́", "1234567890" * 30, "\u0000\u0001", "end "]
    alphabet = "abc the ing 茶咖啡　\n.,'0123é😀"
    texts += ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(2000)]
    for name, own in encoders.items():
        public = reference(name, own)
        assert own.encode(texts) == [public.encode_ordinary(t) if t else [] for t in texts]


def test_encode_documents(spark, encoders):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", None), (1, "hello world", "x")], "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_documents(df, "doc_id", "text").collect()]
    assert sorted(got) == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert bpe.encode_documents(df.limit(0), "doc_id", "text").count() == 0


def test_first_fit_decreasing_against_plain():
    r = random.Random(2)
    for _ in range(50):
        room = r.randint(5, 50)
        sizes = [r.randint(1, room) for _ in range(r.randint(0, 60))]
        bins, free = packing.first_fit_decreasing(sizes, room), []
        expected = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(room)
            free[k] -= sizes[i]
            expected[i] = k
        assert bins == expected


def test_pack(spark):
    r = random.Random(3)
    sizes = [(i, "c", r.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(300)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, container string, tokens long"), {"c": 100}, groups=3).collect()
    by_doc, by_bin = {}, {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append((x.piece, x.first_token, x.tokens))
        if x.bin is not None:
            by_bin[x.bin] = by_bin.get(x.bin, 0) + x.tokens
    assert max(by_bin.values()) <= 100
    for doc, _, tokens in sizes:
        pieces = sorted(by_doc[doc])
        assert sum(p[2] for p in pieces) == tokens and len(pieces) == max(1, -(-tokens // 100))
        assert [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]
    assert sum(by_bin.values()) / (100 * len(by_bin)) > 0.9
    assert packing.pack(spark.createDataFrame([], "doc_id long, container string, tokens long"), {"c": 100}, groups=1).count() == 0


def test_one_form():
    con = lookalikes._connect()
    form = lambda s: con.execute("SELECT one_form($1)", [s]).fetchone()[0]
    same = [("Ａ１（ｂ）", "A1(b)"), ("é", "é"), ("С​at", "Cat"), ("a b　c", "a b c"), ("⽯⾊", "石色"), ("oﬃce Ⅱ", "office II"), ("茶茶", "茶茶"), ("SC‑332", "SC-332"), ("е́", "é"), ("", ""), ("​", ""), (None, None)]
    same += [("5㎏ 20℃ 3㎡", "5kg 20°C 3m²"), ("ՍՏВ".replace("Տ", "S"), "USB"), ("Ꭺɡ", "Ag")]
    for a, b in same:
        assert form(a) == b
    for a, b in [("a", "A"), ("é", "e"), ("²", "2"), ("后", "後"), ("-", "_"), ("a b", "ab")]:
        assert form(a) != form(b)
    assert form("ß²®") == "ß²®" and form("plain 茶 text") == "plain 茶 text"


def test_lookalike_pairs_and_options(spark):
    titles = spark.createDataFrame([(1, "Cat"), (2, "Сat"), (3, "Cat"), (4, "cat"), (5, None), (6, "Ｃat"), (1, "Cat")], "listing_id long, title string")
    got = rows(lookalikes.lookalike_pairs(titles, "listing_id", "title"))
    assert got == [(1, 2), (1, 6), (2, 3), (2, 6), (3, 6)]
    schema = "record_id long, goal struct<goal_options array<string>>, purchase struct<options map<string,string>>"
    data = [(1, (["Ａ", "b", None],), ({"x": "A", "y": "b"},)), (2, (["a"],), ({"x": "A"},)), (3, None, ({"x": "A"},)), (4, (["Ａ"],), None), (5, (["Ａ"],), ({"x": None},)), (1, (["Ａ", "b", None],), ({"x": "A", "y": "b"},))]
    assert rows(lookalikes.lookalike_options(spark.createDataFrame(data, schema))) == [(1, 0)]
    assert lookalikes.lookalike_pairs(titles.limit(0), "listing_id", "title").count() == 0


def test_canonical_instructions():
    same = [
        ("品类: 茶壶; 颜色: 米白; 规格: 1,500ml", "颜色 = 米白 | 规格 = 1500ML | 品 类 = 茶壶"),
        ("「I need a Kettle, size 1.5L!!」", "ｉ ｎｅｅｄ ａ ｋｅｔｔｌｅ / size １．５l"),
        ("品类：茶壶...颜色：米白——规格：5W 用途：送礼", "品类: 茶壶\n颜色: 米白\n规格: 5w\n用途: 送礼"),
        ("最多花１，９００块", "最多花1900块"),
    ]
    for a, b in same:
        assert canonical(a).text == canonical(b).text, (a, b)
    other = [("size 1.5", "size 15"), ("颜色: 米白; 内层颜色: 墨绿; 规格: 5W", "颜色: 墨绿; 内层颜色: 米白; 规格: 5W"), ("5 50", "550"), ("买 -5 件", "买 5 件")]
    for a, b in other:
        assert canonical(a).text != canonical(b).text, (a, b)
    assert canonical(None) is None and canonical(" !") .text == ""
    assert canonical("a 2.50 b 3").numbers == "2.5 3"


def _votes(text):
    return [{v for i, v in enumerate(abuse.VOTERS) if bits >> i & 1} for bits in abuse.windows([text]).votes().tolist()]


def test_abuse_plain_forms():
    assert abuse.plain("给 差 评 的 都 是 狗 - 东 西") == "给差评的都是狗东西"
    words = lambda s: abuse.plain(s).replace(abuse.MARK, "")
    assert words("what a d.u.m.b.a.s.s") == "what a dumbass" and words("the seller is a L#$#R") == "the seller is a loser"
    assert words("你是jian人") == "你是贱人" and words("ｂ​itttch") == "bitch" and words("约\n炮") == "约炮"
    assert abuse.plain("<p>a &lt; b</p>" + "k" * 99 + "<a href='" + "y" * 200 + "'>").split() == ["a", "b", "k" * 99]
    assert abuse.plain(None) == "" and len(abuse.windows(["", None, " 。\n"]).text) == 0


def test_abuse_windows_and_rules():
    assert [len(abuse.windows([t]).text) for t in ("a", "a, b", "a, b, c", "a. b", "1,5 m", "")] == [1, 1, 2, 2, 1, 0]
    assert list(abuse.windows(["a", None, "b, c, d", "e"]).text) in ([0, 2, 2, 3], [2, 2, 0, 3])
    assert _votes("不好意思,包装脏了") == [{"compound", "trade_zh"}] and _votes("USB cable") == [set()]
    assert "contempt_of_group" in _votes("those immigrants are thieves")[0] and _votes("for women and men") == [set()]
    assert "putdown" in _votes("你还好意思说")[0] and "threat" not in _votes("杀菌灯")[0]
    assert abuse.windows(["一只 猫"]).votes().tolist() == [0]


GOOD = ["这款{}的外壳防水吗", "傻瓜相机选购先看{}", "物流走了3天,{}有点湿", "Bought it for my {}, never bent", "I hate the new {} packaging", "东西太垃圾了,{}三天就变形", "The {} was dented but fine"]
BAD = ["你这个{}卖家就是傻逼", "你妈没教你怎么做生意吗,{}废物", "what a bitch, can't even read the {}", "外地人都是小偷,别让他们进{}店", "加V看啪啪,{}全裸无遮挡", "go kill yourself, {} asshole", "再骚扰{}我就找人弄死你"]


def test_abuse_held_out(spark):
    """Trained on some texts, the classifier tells others apart, plain or disguised; nulls and empty texts score 0."""
    r = random.Random(4)
    words = ["茶壶", "kettle", "吹风机", "router", "耳机", "电池"]
    texts = [(i, "s", r.choice(BAD if i % 6 == 0 else GOOD).format(r.choice(words))) for i in range(900)]
    model, w, b = abuse.fit(spark.createDataFrame(texts, "doc_id long, source string, text string"))
    assert all(a >= 0.5 for a in model.accuracies().values())
    held = [(1, "s", "你这个灯卖家就是傻 逼"), (2, "s", "what a b*tch, can't even read the chart"), (3, "s", "这款灯的外壳防水吗"), (4, "s", "I hate the new lamp packaging"), (5, "s", None), (6, "s", ""), (7, None, ("这款灯的外壳防水吗。" * 300) + "加V看啪 啪,全裸无遮挡")]
    got = {x.doc_id: x.score for x in abuse.scored(spark.createDataFrame(held, "doc_id long, source string, text string"), w, b).collect()}
    assert got[1] > 0.5 and got[2] > 0.5 and got[7] > 0.5 and got[3] < 0.5 and got[4] < 0.5 and got[5] == got[6] == 0
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert abuse.scored(none, *abuse.fit(none)[1:]).count() == 0


# Sentences of no template of the tables, written before any of them was scored.
UNSEEN_BAD = """你个蠢驴卖家怎么还没倒闭
就这智商也出来开店,回去读小学吧
客服脑子进水了吧,问啥啥不知道
你全家都是骗子,不得好死
信不信我找人打断你两条胳膊
再发垃圾短信我捅死你
南方人都是骗子,千万别买他们家的
那群移民就是一群寄生虫
女人懂什么数码,回家做饭去吧
这种乡巴佬也配用苹果手机
穷人就不配进我们店
残疾人就别出来丢人现眼了
老板是个王八羔子,收钱不发货
一群饭桶,连个快递都寄不明白
你妈生你的时候把脑子忘了吧
小姐姐今晚寂寞,加微信陪你裸聊
高清色情资源,私聊领取
她脱光衣服躺在床上呻吟
想舔你的奶子
同城约 炮,包夜五百
你就是个 f w,别开店了
滚蛋吧你,死骗子
You are the dumbest moron I ever dealt with
the seller is a lying piece of shit
I know where you live and I will hurt you
hope you rot in hell, you scammer
all those foreigners are criminals, deport them
women are too stupid to review electronics
poor people should be banned from this store
these muslims are vermin
shut up you brainless idiot
your mother should have taught you manners, loser
horny tonight, send nudes on cam chat
she moaned while he stripped her naked
hot porn videos, dm me
what an a$$hole, never answers
you b1tch, give my money back
go back to your village, filthy peasant""".split("\n")
UNSEEN_GOOD = """客服态度一般,等了半小时才回复
这价格太坑了,感觉被骗了
电池续航烂得要死,退了
女款偏小,男士建议拍大一码
适合老人和小孩使用,字很大
床上四件套很柔软,晚上睡得香
胸围90的穿L码刚好
味道辣得变态,过瘾
声音大得吵死人,不推荐
外国人也来问链接,哈哈
狗狗很喜欢这个窝
猪肉脯好吃,回购三次
这个刀真快,切肉杀鱼都行
快递小哥把箱子摔坏了,气死我了
不好意思问一下,能开发票吗
脏了也好洗,白色耐看
老板人很好,还送了贴纸
说明书全是英文,看不懂
你家的杯子什么时候补货
黑人牙膏是正品吗
躺着看手机的支架,很稳
下面的抽屉有点卡
婴儿湿巾没有刺激味道
游戏里总是打死我,鼠标太慢
This blender is a monster, love it
the color is ugly but it works
my old phone is dead, this one is great
killer deal for the price
it sucks the dust very well
the men's version runs large, women should size down
breast milk storage bags leak
the strip lights are bright at night
I hate waiting for delivery
shoot in low light without noise
dirty after one week, easy to wash
the battery died in two days, total garbage
our dog destroyed it within an hour
cheap trash, broke immediately""".split("\n")


def test_abuse_in_sentences_of_no_template(spark):
    """Precision and recall over sentences that neither the tables nor the voters hold."""
    data = "/root/testdata/sf0.01/documents.parquet"
    if not __import__("os").path.exists(data):
        pytest.skip("no test tables here")
    _, w, b = abuse.fit(spark.read.parquet(data))
    rows = [(i, "s", t) for i, t in enumerate(UNSEEN_BAD + UNSEEN_GOOD)]
    got = {x.doc_id for x in abuse.scored(spark.createDataFrame(rows, "doc_id long, source string, text string"), w, b).collect() if x.score >= abuse.FOUND_FROM}
    right = sum(i < len(UNSEEN_BAD) for i in got)
    print("recall", right / len(UNSEEN_BAD), "precision", right / max(1, len(got)), [t for i, _, t in rows if (i < len(UNSEEN_BAD)) != (i in got)])
    assert right / len(UNSEEN_BAD) >= 0.4 and right / len(got) >= 0.9


def test_normal_forms_agree():
    assert all(unicodedata.normalize("NFC", c) == c for c in lookalikes.CYRILLIC[1] + lookalikes.GREEK[1])


def test_fields_by_structure():
    same = [
        ("Material: steel; Shape: round; Price: 5", "price=5 | MATERIAL=Steel | shape=round"), ("口味：原味\n产地：云南", "产地: 云南; 口味: 原味"), ("重 量 - 5kg，口味 - 甜", "口味 - 甜，重量 - 5kg"),
        ("(Lens: wide, fast\nMount type: EF\nHood: none)", "Hood = none | Lens = wide, fast | Mount type = EF"),
    ]
    for a, b in same:
        assert canonical(a).text == canonical(b).text, (a, b)
    other = [("Material: steel; Shape: round", "Material: round; Shape: steel"), ("I want this: a red one, and that: a blue one", "I want that: a blue one, and this: a red one"), ("a: 1; b: 2", "a: 2; b: 1"), ("meet at 10:30 or 11:45", "meet at 11:45 or 10:30")]
    for a, b in other:
        assert canonical(a).text != canonical(b).text, (a, b)
    assert canonical(":").text == "" and canonical("a:b:c:d").fields and canonical(":=" * 500).text == ""
