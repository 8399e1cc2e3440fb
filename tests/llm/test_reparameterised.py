"""Benchmark questions asked again with other names, numbers, number words and units, in four languages."""

import random

from sketchgraph.llm import decontaminate

QUESTIONS = {
    "en": [
        "{n} has {a} apples and {b} pears. {m} gives her {c} more apples each day. How many apples does she have after {d} days?",
        "A train leaves {p} at {a} km per hour and another leaves {q} at {b} km per hour. When do they meet if the distance is {c} km?",
        "In {p}, a baker makes {a} loaves of bread every day. {n} buys {b} of them. How many loaves are left at the end of the week?",
        "{n} is {a} years old. {m} is twice as old as {n}. In {b} years, how old will {m} be?",
    ],
    "de": ["{n} hat {a} Äpfel und {b} Birnen. {m} gibt ihr jeden Tag {c} weitere Äpfel. Wie viele Äpfel hat sie nach {d} Tagen?", "Ein Zug fährt von {p} mit {a} Kilometer pro Stunde ab. Nach wie vielen Stunden erreicht er {q}, wenn die Strecke {b} Kilometer lang ist?"],
    "fr": ["{n} a {a} pommes et {b} poires. {m} lui donne {c} pommes de plus chaque jour. Combien de pommes a-t-elle après {d} jours ?", "{n} achète {a} livres à {b} euros et {m} achète {c} stylos à {d} euros. Combien {n} dépense de plus que {m} ?"],
    "es": ["{n} tiene {a} manzanas y {b} peras. {m} le da {c} manzanas más cada día. ¿Cuántas manzanas tiene después de {d} días?", "Un tren sale de {p} a {a} kilómetros por hora. ¿Después de cuántas horas llega a {q} si la distancia es de {b} kilómetros?"],
}
NAMES, PLACES = "Anna Tom Bertha Carl Dora Emil Frieda Maria Pedro Pierre Claire Emma Noah Liam".split(), "Paris Berlin Madrid London Rome Vienna Boston Lyon".split()
COUNTS = {"en": "two three four five seven eight nine ten twelve", "de": "zwei drei vier fünf sieben acht neun zehn zwölf", "fr": "deux trois quatre cinq sept huit neuf dix douze", "es": "dos tres cuatro cinco siete ocho nueve diez doce"}
UNITS = {"en": (("km", "miles"), ("days", "weeks")), "de": (("Kilometer", "Meilen"), ("Tagen", "Wochen")), "fr": (("euros", "dollars"), ("jours", "semaines")), "es": (("kilómetros", "millas"), ("días", "semanas"))}


def filled(r, lang, question, words=False, units=False):
    number = (lambda i: COUNTS[lang].split()[i % 9]) if words else (lambda i: 11 + 7 * i)
    values = dict(zip("nm", r.sample(NAMES, 2))) | dict(zip("pq", r.sample(PLACES, 2))) | dict(zip("abcd", map(number, r.sample(range(9), 4))))
    out = question.format(**values)
    for a, b in UNITS[lang] if units else ():
        out = out.replace(a, b)
    return out


def flagged(spark, docs, items):
    got = decontaminate.flag_leaks(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([*enumerate(items)], "item_id long, text string"))
    return [r["items"] for r in got.orderBy("doc_id").collect()]


def test_recall_and_clean_documents(spark):
    r = random.Random(3)
    every = [(lang, q) for lang, qs in QUESTIONS.items() for q in qs]
    items = [filled(r, lang, q) for lang, q in every]
    docs, want = [], []
    for i, (lang, q) in enumerate(every):
        for k in range(12):
            before, after = r.choice([("", ""), ("We know this. ", " Yes, indeed."), ("so the story goes: ", " and that is all"), ("One line of text.\n", "\nAnother line.")])
            docs.append(before + filled(r, lang, q, words=k % 3 == 1, units=k % 3 == 2) + after)
            want.append(i)
    got = flagged(spark, docs, items)
    assert sum(w in g for w, g in zip(want, got)) >= 0.97 * len(docs) and all({*g} <= {w} for w, g in zip(want, got))
    words = [w for t in docs for w in t.split()]
    clean = [" ".join(r.choice(words) for _ in range(60)) for _ in range(100)]  # the same words in another order
    halves = [" ".join(t.split()[: len(t.split()) // 2]) for t in docs]
    assert not any(flagged(spark, clean + halves, items))


def test_slots_agree_both_ways_and_over_distances(spark):
    first, second = "it was Anna who sold 5 red hats and then bought 7 blue ones for Tom", "who gave Anna back the 5 red hats that he never wore"
    item = f"{first} {second}"
    other = lambda text, n, m, a, b: text.replace("Anna", n).replace("Tom", m).replace("5", a).replace("7", b)
    filler = " as we all know very well by now "
    docs = [
        other(item, "Emma", "Carl", "8", "9"), other(item, "Emma", "Carl", "8", "8"), other(item, "Emma", "Emma", "8", "9"),
        other(first, "Emma", "Carl", "8", "9") + filler + other(second, "Emma", "Carl", "8", "9"), other(first, "Emma", "Carl", "8", "9") + filler + other(second, "Dora", "Carl", "8", "9"),
        other(first, "Emma", "Carl", "8", "9") + " and" * 500 + " " + other(second, "Emma", "Carl", "8", "9"),
        other(item, "Emma", "Carl", "8", "9") + filler + other(item, "Dora", "Emil", "3", "4"),
    ]
    item_long = item + " so she wore them all at once on the day of the feast"
    docs = [d + " so she wore them all at once on the day of the feast" for d in docs]
    assert flagged(spark, docs, [item_long]) == [[0], [], [], [0], [], [], [0]]
