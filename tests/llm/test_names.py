"""Variant spellings: what is read, what links, what stays apart, and the defined edge cases."""

import random

import pytest

from tidewire.llm import names as N

E = "id bigint, normalized_name string, original_name string, type string, entity string"
A = "id int, alias_name string, key string"


def pairs(spark, entities, aliases=()):
    e = spark.createDataFrame([(i, n, o, "wrong", "clash") for i, n, o in entities], E)
    a = spark.createDataFrame([(i, n, "clash") for i, n in aliases], A)
    return {tuple(r) for r in N.linked_pairs(e, a).collect()}


@pytest.mark.parametrize(
    "a,b",
    [
        ("Леонид Цожажогутин", "Leonid Tsozhazhogutin"), ("Леонид Цожажогутин", "ЦОЖАЖОГУТИН, Лёня"), ("Юлии Росабажаниной", "Юля Росабажанина"), ("Елена Серободолова", "Елена Сepoбoдoлoвa"),
        ("Мемекопен Транс", "АО «Мемекопен-Транс»"), ("Бушижуцантранс", "\"Бушижуцан\" Транс"), ("Чекимицур Телеком", "ТК Чекимицур"), ("агро «Тоцикомара»", "Агр. Тоцикомар"),
        ("Цацогезатский комбинат сухих смесей", "Комбинат сухих смесей (Цацогезатск)"), ("Цацогезатский КСС", "Tsatsogezatskiy KSS"), ("Цацогезат. ком-т сухих смесей", "Цацогезатского комбината сухих смесей"),
        ("г. Носицалилск", "Nositsalilsk"), ("Город Носицалилск", "Носицалилска"), ("Форум «Цомефашел-2026»", "Цомефашел'26"), ("Программа «Кожуледор»", "Кожуледор, программа"),
    ],
)
def test_same_profile(a, b):
    p, q = N.read_name(a), N.read_name(b)
    assert p[:3] == q[:3], (p, q)


@pytest.mark.parametrize(
    "a,b",
    [
        ("Светлана Вунувунаненко", "Елена Вунувунаненко"), ("Сехакецар Агро", "Сехакецар Банк"), ("Цобацичотский завод точных приборов", "Цобацичотский центр морских расчетов"),
        ("Цопунимурск", "Цопунимурская область"), ("Форум «Коцахошит-2022»", "Форум «Коцахошит-2023»"), ("Индекс «Некепуцир»", "Метод «Некепуцир»"),
    ],
)
def test_other_profile(a, b):
    assert N.read_name(a)[:3] != N.read_name(b)[:3]


def test_debris():
    for name in (None, "", " ", "#13", "24 —", "📈65", "nbsp;"):
        assert N.read_name(name) is None
    assert N.read_name("сло" * 100_000) is not None


def test_rounds(spark):
    # The initial and the bare surname reach the full name only through it; a slip that one spelling shares carries on.
    e = [(1, "Леонид Нужокеруменко", None), (2, "Л. Нужокеруменко", "Л.Нужокеруменко"), (3, "Нужокеруменко", None), (4, "Леонид Нужокерумемко", "Леонид Нужокеруменко"), (5, "Григорий Сереторасов", None), (6, "Владимир Сереторасов", None), (7, "Сереторасов", None), (8, "В. Сереторасов", None), (9, None, None)]
    got = pairs(spark, e, [(1, "г-н Л. Нужокеруменко"), (2, None), (3, "")])
    one = ["a1", "e1", "e2", "e3", "e4"]
    assert got == {(x, y) for i, x in enumerate(one) for y in one[i + 1 :]} | {("e6", "e8")}


def test_slips_and_codes(spark):
    e = [(1, "Магагемунский завод точных приборов", None), (2, "Магагемунский завод точных рпиборов", None), (3, "Магагемунский ЗТП", None), (4, "Магагемунский ИРЯ", None), (5, "Хасутунерск", None), (6, "Хасутунерзк", None), (7, "Зичугерамина Светлана", None), (8, "Светлана Зчиугермаина", None)]
    assert pairs(spark, e) == {("e1", "e2"), ("e1", "e3"), ("e2", "e3"), ("e5", "e6"), ("e7", "e8")}


def test_repeated_and_empty(spark):
    assert pairs(spark, []) == set()
    many = [(i, "Пикукукел Нефть", "Нефть Пикукукел") for i in range(20)]
    assert len(pairs(spark, [*many, many[0]])) == 190


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in N.components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_distance():
    assert [N.distance(a, b) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "ab"), ("abcd", "badc"), ("abc", "xyz"))] == [0, 1, 1, 2, 3]


def test_two_slips_anywhere(spark):
    from itertools import combinations

    core = "nuqokerumenko"
    other = [core] + ["".join("w" if k in at else c for k, c in enumerate(core)) for at in combinations(range(len(core)), 2)]
    other += [core[1:-1], "w" + core + "w", "un" + core[2:-2] + "ok", "w" + core[:-1]]
    rows = [(k, "s", v, True) for k, v in enumerate(other)]
    got = {r["b"]: r["d"] for r in N.near_pairs(spark.createDataFrame(rows, "id bigint, stratum string, core string, wide boolean")).filter("a = 0").collect()}
    assert got == dict.fromkeys(range(1, len(other)), 2)


def test_slips_at_both_ends(spark):
    e = [(1, "Леонид Нужокеруменко", None), (2, "Леонид Мужокеруменхо", None), (3, "Леонид Мужакеруменхо", None)]
    assert pairs(spark, e[:2]) == {("e1", "e2")}
    assert pairs(spark, [e[0], e[2]]) == set()


def test_distance_of_long_spans():
    import random

    def plain(a, b):
        d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return min(3, d[len(a), len(b)])

    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choices("abcd", k=rng.randrange(15)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = rng.choices("abcd", k=rng.randrange(3))
        assert N.distance(a, "".join(b)) == plain(a, "".join(b))
    assert N.distance("nuqokerumenko", "muqokerumenho") == 2


def test_rounds_go_on_until_nothing_merges(spark, monkeypatch):
    names = [(f"e{k}", [f"Леонид {x}"]) for k, x in enumerate(("Нужокеруменко", "Сереторасов", "Вунувунаненко", "Цожажогутин", "Росабажанин", "Серободолов", "Зичугерамин", "Бушижуцанов", "Тоцикомаров"))]
    real, ids = N._rematch, []

    def one_by_one(profiles, found):
        real(profiles, found)
        ids[:] = ids or sorted(r["id"] for r in profiles.select("id").collect())
        one_by_one.calls += 1
        k = one_by_one.calls
        return spark.createDataFrame([(ids[k - 1], ids[k])] if k < len(ids) else [], "a bigint, b bigint")

    one_by_one.calls = 0
    monkeypatch.setattr(N, "_rematch", one_by_one)
    got = N.resolve(spark.createDataFrame(names, "key string, names array<string>")).collect()
    assert len(got) == 9 and len({r["entity"] for r in got}) == 1


def test_unfinished_components_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        N.components(edges, most=2)


@pytest.mark.parametrize("form", ["Леонид {}", "Форум «{}-2026»", "Программа «{}»", "{} Нефть", "{}нефть", "Л. {}", "{}", "{} вокавок тиватив"])
def test_long_names_are_read_whole(form):
    one, two = ("Цожажогут" * 30 + x for x in ("ин", "ов"))
    assert N.read_name(form.format(one))[:3] != N.read_name(form.format(two))[:3]
    assert N.read_name(form.format(one)) == N.read_name(form.format(one.upper()))
    assert N._deletions(N.read_name(form.format(one))[1], 2) == {N.read_name(form.format(one))[1]}


def test_things_are_matched_again_after_a_merge(spark):
    rows = [("e1", ["Банк Северстанин", "Агро Южногорин"]), ("e2", ["Агро Северстанин"]), ("e3", ["Телеком Северстанин"]), ("e4", ["Банк Южногорин"]), ("e5", ["Агро Северстаннин"])]
    got = {r["key"]: r["entity"] for r in N.resolve(spark.createDataFrame(rows, "key string, names array<string>")).collect()}
    # One record unites two brands and two lines: it meets every brand with every line of its own.
    assert got["e1"] == got["e2"] == got["e4"] == got["e5"] != got["e3"]


def test_long_names_with_slips_are_linked(spark):
    long = "".join(random.Random(5).choices("бвгдзклмнпрст", k=64)) + "ин"
    slip, two, far = long[:20] + "ж" + long[21:], "жж" + long[2:], "ж" + long[1:30] + "жж" + long[32:]
    forms = ["Леонид {}", "Форум «{}-2026»", "Программа «{}»", "{} Нефть"]
    e = [(10 * k + i, f.format(x), None) for k, f in enumerate(forms) for i, x in enumerate((long, slip))]
    e += [(100, f"Леонид {two}", None), (101, f"Леонид {far}", None), (102, f"Форум «{far}-2026»", None)]
    got = pairs(spark, e)
    assert got == {(f"e{10 * k}", f"e{10 * k + 1}") for k in range(4)} | {("e0", "e100"), ("e1", "e100")}


@pytest.mark.parametrize("wide,edits", [(False, 1), (True, 2)])
def test_slips_in_cores_about_the_long_ones(spark, wide, edits):
    rng = random.Random(7)
    rows = []
    for size in (61, 62, 63, 64, 65, 66, 200):
        for at in range(0, size - 1, 3):
            core = list(rng.choices("bdgklmnprst", k=size))
            other = core.copy()
            for _ in range(edits):
                i = (at + rng.randrange(size - 3)) % (len(other) - 1)
                other[i : i + 2] = rng.choice(([other[i + 1], other[i]], [other[i]], [*other[i : i + 2], "w"], ["w", other[i + 1]]))
            rows += [(len(rows) + k, str(len(rows)), "".join(x), wide) for k, x in enumerate((core, other))]
    true = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if N.distance(a[2], b[2]) <= edits}
    got = {(r["a"], r["b"]) for r in N.near_pairs(spark.createDataFrame(rows, "id bigint, stratum string, core string, wide boolean")).collect() if r["d"] <= edits}
    assert len(true) > 150 and got == true


def test_short_full_names_with_swapped_letters_are_linked(spark):
    # Two swaps in five letters; the same consonants in seven letters and five.
    e = [(1, "Леонид Гикпа", None), (2, "Леонид Игпка", None), (3, "Леонид Тарамуч", None), (4, "Леонид Трамч", None)]
    assert pairs(spark, e) == {("e1", "e2"), ("e3", "e4")}


def test_the_longer_core_counts_in_either_order(spark):
    cores = [(k, f"s{k // 2}", x, False) for k, x in enumerate(("nuqo", "nuqok", "nuqok", "nuqo"))]
    got = N.near_pairs(spark.createDataFrame(cores, "id bigint, stratum string, core string, wide boolean")).collect()
    assert {(r["a"], r["b"], r["n"]) for r in got} == {(0, 1, 5), (2, 3, 5)}


def test_distance_of_very_long_names():
    core = "слово" * 40_000
    assert [N.distance(core, x) for x in ("ж" + core[1:-1] + "ж", "ж" + core[:-1], core[::-1])] == [2, 2, 3]
