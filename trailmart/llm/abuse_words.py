"""Words of the voters for abusive language, by class, and the rules by which classes make votes.

Fixed values: ordinary vocabulary of insults, threats, contempt and sex, words for persons and groups of people,
words of trade, and compounds in which a bad-looking word is harmless. A class is no vote yet: most rules ask for
two classes within two neighbouring clauses, such as a group of people and contempt.
"""

from __future__ import annotations

INSULTS_ZH = (
    "傻逼 傻叉 傻缺 脑残 脑瘫 蠢猪 蠢驴 蠢货 神经病 贱人 贱货 贱骨头 畜生 禽兽 王八蛋 王八羔子 狗东西 狗杂种 狗屎 狗娘养 废物 窝囊废 白痴 智障 弱智 低能儿 杂种 人渣 败类 "
    "混蛋 混账 婊子 骚货 荡妇 流氓 无赖 泼妇 丑八怪 乡巴佬 土鳖 饭桶 草包 老不死 猪狗不如 草泥马 操你 他妈的 去你妈 死全家 滚犊子"
).split()
SEXUAL_ZH = "约炮 打炮 一夜情 裸聊 口交 肛交 啪啪 做爱 性交 性爱 自慰 手淫 成人视频 成人电影 卖淫 嫖娼 援交 包夜 黄片 毛片 色情 情色 春药 艳照 裸照 叫床 招嫖".split()
PINYIN = dict(
    pair.split(":")
    for pair in "傻:sha 逼:bi 脑:nao 残:can 瘫:tan 蠢:chun 猪:zhu 驴:lv 神:shen 经:jing 病:bing 贱:jian 人:ren 畜:chu 生:sheng 王:wang 八:ba 蛋:dan 狗:gou 东:dong 西:xi 屎:shi "
    "废:fei 物:wu 白:bai 痴:chi 杂:za 种:zhong 渣:zha 货:huo 智:zhi 障:zhang 弱:ruo 混:hun 婊:biao 子:zi 娘:niang 养:yang 骚:sao 约:yue 炮:pao 打:da 一:yi 夜:ye 情:qing "
    "裸:luo 聊:liao 口:kou 交:jiao 啪:pa 做:zuo 爱:ai 成:cheng 视:shi 频:pin 卖:mai 淫:yin 嫖:piao 娼:chang 黄:huang 片:pian 性:xing 自:zi 慰:wei 色:se 禽:qin 兽:shou 败:bai 类:lei".split()
)
#: Other usual writings, each for the word it stands for.
WRITINGS = {
    "煞笔": "傻逼", "傻x": "傻逼", "沙比": "傻逼", "傻b": "傻逼", "sb": "傻逼", "肥物": "废物", "fw": "废物", "nc": "脑残", "果聊": "裸聊", "约💥": "约炮", "约p": "约炮", "cnm": "操你", "tmd": "他妈的",
    "做愛": "做爱", "性愛": "性爱", "腦殘": "脑残", "廢物": "废物", "賤人": "贱人", "賤貨": "贱货", "蠢豬": "蠢猪", "畜牲": "畜生", "賣淫": "卖淫", "黃片": "黄片", "神經病": "神经病", "雜種": "杂种", "狗東西": "狗东西", "智障兒": "智障"}
INSULTS_EN = (
    "idiot moron imbecile cretin loser bastard bitch scumbag dumbass jackass asshole arsehole retard whore slut fucker motherfucker cunt dickhead shithead prick twat wanker douchebag halfwit dimwit"
).split()
SEXUAL_EN = "porn porno sex nudes blowjob handjob orgasm hookup threesome erotica masturbate xxx".split()
LEET = {"a": "a@4", "b": "b8", "e": "e3", "g": "g9", "i": "i1!", "l": "l1", "o": "o0", "s": "s$5", "t": "t7+"}

#: Class -> words. Latin words count at word bounds only, with an ending s or es.
CLASSES: dict[str, list[str]] = {
    "insult_zh": INSULTS_ZH,
    "insult_en": [*INSULTS_EN, "piece of shit", "son of a"],
    "sexual_zh": SEXUAL_ZH,
    "sexual_en": SEXUAL_EN,
    "person": "你 您 卖家 店主 店家 商家 客服 老板 评论的人 差评的 这种人 那种人 you your yourself ur seller shopkeeper".split(),
    "contempt": (
        "蠢 笨 丑 脏 贱 傻 懒 恶心 垃圾 没用 无能 下等 低等 低人一等 寄生虫 牲口 害虫 蛀虫 小偷 骗子 强盗 罪犯 野蛮 狗 猪 没脑 "
        "stupid ugly dirty filthy vermin animal thief thieves brainless pathetic worthless disgusting parasite trash scum inferior rats criminal liars dumb useless subhuman lazy"
    ).split(),
    "group": [
        *"外地人 乡下人 农村人 城里人 女人 男人 女的 男的 老头 老太 老人 老年人 残疾人 瘸子 聋子 瞎子 哑巴 移民 难民 外国人 黑人 白人 亚洲人 穆斯林 犹太人 教徒 教的 同性恋 北方人 南方人 东北人 穷人 民工 那帮 这帮 那群 这群 土话的 方言的 口音的 那边来的".split(),
        *"immigrant migrant refugee foreigner women woman elderly believer muslim jew christian hindu gay lesbian peasant villager southerner northerner".split(),
        *("old folks", "old people", "disabled people", "blind people", "deaf people", "black people", "white people", "poor people", "hill people", "mountain people", "people from", "those people", "you people", "these people", "men"),
    ],
    "exclude": [
        *"滚回 滚出 赶走 赶出 不配 不卖给 不该让 别来 天生 生来 不许进 不准进 一看就是".split(),
        *("back where", "go back to", "are born", "born stupid", "never trust", "typical", "disappear", "disappeared", "better off if", "better off without", "banned", "get out of", "kick out", "deport", "do not belong", "don't belong", "not sell to", "all of them", "every one of"),
    ],
    "threat": [
        *"弄死 打死你 杀死你 砍死 捅死 撞死 掐死 杀了你 打断 挨揍 揍你 揍死 去死 不得好死 暴毙 遭报应 断子绝孙 死全家 弄残 灭你".split(),
        *("kill you", "kill yourself", "drop dead", "hope you die", "break your", "beat you", "hurt you", "find you and", "chokes", "choke on", "burn in hell", "rot in hell", "stab you", "strangle", "slit your", "know where you live"),
    ],
    "putdown": [
        *"没教养 没家教 没教你 没素质 说人话 浪费粮食 浪费空气 好意思 照照镜子 你妈 你爹 你爸 你娘 你全家 丢人 滚远 滚蛋 滚开 闭嘴 骂你".split(),
        *("shut up", "nobody asked", "can't even", "cannot even", "your mother", "too ugly", "too stupid", "too dumb", "go to hell", "waste of"),
    ],
    "addled": [*"脑子被 脑子进 脑子有病 脑子坏 脑袋被 脑袋进 没长脑 没脑子".split(), *("brainless", "brain dead")],
    "wits": [*"智商 脑子".split(), *("no brain", "brain", "iq")],
    "schooling": [*"没毕业 没文化 没读过书 文盲 小学吧".split(), *("illiterate", "can't read", "uneducated")],
    "bare": [*"裸 脱光 脱衣 呻吟 露点 摸我 奶子 高潮 赤裸".split(), *"naked nude moan moaned moaning horny topless undress".split()],
    "place": "床上 今晚 躺 tonight bedtime".split(),
    "body": "胸 下面 湿了 臀 大腿 breast butt thigh".split(),
    "act": "摸 揉 寂寞 想要 舔 strip lick lonely grope".split(),
    "offer": [*"私聊 加v 加微 资源 上门 元一次 包月看 无遮挡".split(), *("dm me", "click my", "my profile", "per hour", "no limits", "cam chat", "call me")],
    "trade_zh": "价格 物流 发货 退货 包装 质量 颜色 规格 赠品 说明书 活动价 满减 检测 实物 图片 回购 快递 尺寸 型号 性价比 预算 店铺 支持 选购 建议 商品 推荐 好评 到手 手感".split(),
    "trade_en": "price manual battery discount photo refund size color colour shipping delivery box bought purchase ordered return reason support weeks months quality package warranty fair instruction item".split(),
    "compound": [
        *"傻瓜相机 傻瓜式 垃圾袋 垃圾桶 垃圾分类 太垃圾了 处女座 直男 变态辣 杀菌 死结 公鸡 鸡胸 死机 纸尿裤 尿不湿 杀疯 内衣 胸罩 文胸 笑死 累死 热死 吓死 好用到哭 烂透 滚筒 滚轮 不好意思 床上用品 狗粮 猫狗 宠物狗 狗窝 猪肉 猪年 下面条 胸围 胸包 胸肉 吸奶 乳头 裸机 裸妆 裸色 裸重 脏衣 容易脏 耐脏 不脏 躺椅 躺平 按摩 抚摸 大腿围 懒人 傻乎乎 臀围".split(),
        *("chicken breast", "breast pump", "dumb phone", "dumb bell", "trash bag", "trash can", "screw set", "cockpit", "adult size", "total garbage", "stupidly", "damn good", "a beast", "led strip", "power strip", "hate the", "dirty laundry", "lazy susan", "animal print", "stuffed animal", "strip light", "bed sheet"),
    ],
    "page": [*"点击 搜索 按钮 之间有".split(), *("http", "click[", "search[", "click on")],
    "disguised": [""],
}
NAMES = list(CLASSES)
BIT = {n: 1 << i for i, n in enumerate(NAMES)}


def _has(mask: int, *classes: str) -> bool:
    return all(mask & BIT[c] for c in classes)


#: Voters: name, vote, and the rule over the classes found.
RULES = [
    ("insult_zh", 1, lambda m: _has(m, "insult_zh")),
    ("insult_en", 1, lambda m: _has(m, "insult_en")),
    ("sexual_zh", 1, lambda m: _has(m, "sexual_zh")),
    ("sexual_en", 1, lambda m: _has(m, "sexual_en")),
    ("threat", 1, lambda m: _has(m, "threat")),
    ("putdown", 1, lambda m: sum(_has(m, c) for c in ("putdown", "wits", "schooling", "insult_zh", "insult_en", "person")) >= 2 and (_has(m, "putdown") or _has(m, "wits") or _has(m, "schooling"))),
    ("addled", 1, lambda m: _has(m, "addled")),
    ("contempt_of_person", 1, lambda m: _has(m, "contempt", "person", "putdown") or _has(m, "contempt", "person", "threat")),
    ("contempt_of_group", 1, lambda m: _has(m, "group", "contempt")),
    ("exclusion", 1, lambda m: _has(m, "group", "exclude")),
    ("bare", 1, lambda m: _has(m, "bare")),
    ("body", 1, lambda m: sum(_has(m, c) for c in ("place", "body", "act", "bare")) >= 2),
    ("offer", 1, lambda m: _has(m, "offer") and any(_has(m, c) for c in ("sexual_zh", "sexual_en", "bare", "place", "body"))),
    ("addressed", 1, lambda m: _has(m, "person") and (_has(m, "insult_zh") or _has(m, "insult_en"))),
    ("disguised", 1, lambda m: _has(m, "disguised")),
    ("trade_zh", -1, lambda m: _has(m, "trade_zh")),
    ("trade_en", -1, lambda m: _has(m, "trade_en")),
    ("compound", -1, lambda m: _has(m, "compound")),
    ("page", -1, lambda m: _has(m, "page")),
]
VOTERS = [n for n, _, _ in RULES]
SIGNS = [v for _, v, _ in RULES]
POSITIVE = sum(1 << i for i, v in enumerate(SIGNS) if v > 0)


def votes_of(mask: int) -> int:
    """The voters that vote where these classes are found, as bits."""
    return sum(1 << i for i, (_, _, rule) in enumerate(RULES) if rule(mask))
