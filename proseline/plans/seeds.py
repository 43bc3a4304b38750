"""Documents with sentences put after them in which the linter's rules and the stock phrases do occur: the tables' own texts have few.

Which sentence a document gets follows from its id; every rule has some, and some that only look like it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.functions.lazy import STANDARD_LITERALS

#: Each with the rule that it is for.
SENTENCES = [
    ("slop_words", "A crucial tapestry of robust things, moreover a game-changing one; uncrucial and delveing are none."),
    ("slop_phrases", "In conclusion, in addition to that, here's the thing: let me know if I can also help. At the end of the day, put differently, it's worth noting."),
    ("not_just", "It is not just a dog, but also a cat, and not only here, but there."),
    ("bold", "**One.** first **Two:** second **Three.** third"),
    ("bullet_runs", "- a\n- b\n* c\n1. d\n2. e\n- f\nend"),
    ("bullet_runs", "- a\n- b\n* c\n1. d\n2. e\n- f\n- g"),
    ("triadic", "red, green, and blue; one, two, and three; a, b, and c; d, e, and f; g, h, and i; j, k, and l"),
    ("tone_phrases", "Feel free to ask, and don't hesitate to write. That's when everything changed, as mentioned."),
    ("openers", "He said. Certainly, yes. Absolutely! Uncertainly, no.\nCertainly not."),
    ("weasel", "Many believe that studies show it, some critics argue, and research suggests more; some argued."),
    ("ai_disclosure", "As an AI, I'm just an AI. I cannot browse, as of my last cutoff; as an aide."),
    ("placeholder", "Dear [insert name], see [url here], [your city], [todo] and [describe it]; [other]."),
    ("rhythm", "One two three four. Five six seven eight. Nine ten two one. Three four five six. Seven eight nine ten."),
    ("em_dash", "one — two — three — four -- five — six — seven — eight — nine — ten — eleven"),
    ("contrast_pairs", "light, not dark; warm, not cold; big, not small; old, not new; wet, not dry; up, not down"),
    ("setup_resolution", "This isn't a test, it's a start. They are not late; they are early. It's not much, it's all. We don't stop: instead we go."),
    ("colon_density", "note: this and more: that, so: there, then: here, json: true, http: x, see: where, and: why"),
    ("pithy_fragment", "Good, but bad. Red, and blue. Slow, yet sure. Old, not new. This one, however long it may be, is none."),
    ("bullet_density", "\n".join(f"{k}) item" for k in range(400))),
    ("quotes", "> a\n> b\n> c\n> d\n> e\n> f\n> g"),
    ("bold_bullet_list", "- **A** x\n- **B** y\n3. **C** z\nend\n* **D** x\n* **E** y\n* **F** z"),
    ("horizontal_rules", "---\na\n***\nb\n___\nc\n----\nd"),
    ("phrase_reuse", "the old red house stood there. the old red house stood here. the old red house stood alone."),
    ("regexes", "so so so fine.... Well... or not... stop!!! His eyes of steel. He whispered. She slowly turned away. It tasted like iron and salt. Not one word. No more words."),
    ("regexes", "The dog ran. The dog sat. The dog ate. A heart of stone — no home, not here."),
    ("nothing", "plain words"),
]


def seeded(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the document's sentence and five stock phrases after it."""
    i = F.col("doc_id")
    literals = F.array(*map(F.lit, STANDARD_LITERALS))
    phrases = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.get(literals, ((i * 5 + j) % len(STANDARD_LITERALS)).cast("int"))), " ")
    sentence = F.get(F.array(*[F.lit(s) for _, s in SENTENCES]), (i % len(SENTENCES)).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), sentence, F.lit("\n"), phrases).alias("text"))


def seeded_sql(query: str) -> str:
    """The SQL of a query over documents, over the seeded ones."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    literals, sentences = ", ".join(map(q, STANDARD_LITERALS)), ", ".join(q(s) for _, s in SENTENCES)
    phrases = f"array_to_string(list_transform(range(5), lambda j: ([{literals}])[(doc_id * 5 + j) % {len(STANDARD_LITERALS)} + 1]), ' ')"
    made = f"documents AS MATERIALIZED (SELECT doc_id, coalesce(text, '') || chr(10) || chr(10) || ([{sentences}])[doc_id % {len(SENTENCES)} + 1] || chr(10) || {phrases} AS text, source, lang FROM documents)"
    return query.strip().replace("WITH ", f"WITH {made}, ", 1)
