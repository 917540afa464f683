import random

from trailmart.llm import listings

PRODUCT = "listing_id long, title string, brand string, attributes array<string>"


def test_title_words():
    words = lambda t: listings.title_words(listings.plain(t))
    assert words("6 kg 1800 w Drum Washer") == ["drum", "washer"]
    assert words("WENISTVOK 护颈枕 40 cm 1500克") == ["wenistvok", "护颈枕"]
    assert words("瑞艾 CQ-6021Pro 显示器/36W") == ["瑞艾", "cq6021", "pro", "显示器"]
    assert words("瑞艾 槿茉竹系列Pro (Max) 保温杯") == ["瑞艾", "槿茉竹", "pro", "max", "保温杯"]
    assert words("BZ 4831 米白 杯") == ["bz", "4831", "米白", "杯"] and words("") == []
    assert listings.specifications([listings.plain("BZ4831 米白 5.5L")]) == {"volume": [5500.0]}


def test_phrases():
    assert listings.phrases(["sony", "wh1000xm5", "black"], {"sony": 1}) == ["wh1000xm5", "black"]
    assert listings.phrases(["iphone", "15", "pro"], {}) == ["iphone", "iphone\x1f15"]
    assert listings.phrases([], {}) == []


CODES = ["WH-1000XM5", "A2337", "iPhone 15", "RTX 4080", "SM-G991B", "CQ-6021"]


def test_codes_of_many_shapes(spark):
    """Six shapes of codes are mined by association, in either writing, and listings without a brand get theirs."""
    r = random.Random(8)
    names = [f"Maker{chr(97 + i)}" for i in range(12)]
    brands = spark.createDataFrame([(i, n, None) for i, n in enumerate(names)], "brand_id int, latin_name string, zh_name string")
    kinds, words = ["headphones", "laptop", "phone", "card", "monitor"], ["new", "cheap", "black", "sale", "original", "boxed", "light", "fast"]
    data, wanted, key = [], {}, 0
    for b, code in enumerate(CODES):
        for form in (code, code.replace("-", ""), code.replace("-", " ") if code.count("-") == 1 and code[-1].isdigit() else code, code.lower()):
            title = [*r.sample(words, 2), form, r.choice(kinds)]
            brand = names[b] if len(wanted.get(b, ())) < 3 else None
            data.append((key, " ".join(([brand] if brand else []) + title), brand, None))
            wanted.setdefault(b, set()).add(key)
            key += 1
    for _ in range(400):  # other listings, each with a code of its own
        b = r.randrange(12)
        data.append((key, f"{names[b]} {' '.join(r.sample(words, 2))} {r.choice('XYZ')}{r.randint(100, 999)}{r.choice('abc')}{r.randint(10, 99)} {r.choice(kinds)}", names[b], None))
        key += 1
    found = {}
    for x in listings.items(spark.createDataFrame(data, PRODUCT), brands).collect():
        found.setdefault((x.brand_id, x.model), set()).add(x.listing_id)
    for b, members in wanted.items():
        assert members in found.values(), (CODES[b], [k for k, v in found.items() if v & members])


def test_dictionary_in_parts_gives_the_same(spark):
    brands = spark.createDataFrame([(1, "Rhiebb", "瑞艾"), (2, "Zomfro", "佐弗")], "brand_id int, latin_name string, zh_name string")
    data = [(i, f"{('Rhiebb', 'Zomfro', '')[i % 3]} {'new' if i % 2 else 'hot'} kettle MX-{1000 + i // 6} 2L", None, None) for i in range(120)]
    read = listings.read_listings(spark.createDataFrame(data, PRODUCT), listings.brand_names(brands)).cache()
    dictionary = listings.mine_dictionary(read).cache()
    whole, parts = (sorted(tuple(x) for x in listings.match_models(read, dictionary, n).collect()) for n in (100_000, 7))
    assert whole == parts and len(whole) > 60
