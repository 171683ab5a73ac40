import random

import pytest

from quotemill.llm.residue import KINDS, Matcher, exemplars, plain, residue_marks, tokens

RESIDUE = [
    "Please enable JavaScript to view this page.",
    "TO CONTINUE, TURN ON J A V A S C R I P T AND COOKIES.\n\nTHANK YOU.",
    "Acme Holdings (ACME) Bitte aktivieren Sie JavaScript, um den Artikel zu lesen.",
    "502 Bad Gateway Reload the page and sign in again. Reference #807.9a2cb39961",
    "Seite nicht gefunden\n\nError code: E8850\n\nnginx",
    "404 Not Found The requested address was not found on this server. Home | Contact | Terms",
    "Dolor mollit velit velit officia mollit labore pariatur sint pariatur quis. Duis fugiat mollit.",
    "xxx xxx xxxxx xxxx xx xxxxxx xxx. xxx xxx xxxxx.",
    "Headline goes here. Standfirst goes here. Body copy goes here.",
    "Shares of {{company}} closed at 12.40 on Friday, a move of 3 percent on heavy volume.",
    "Net income came to ${amount} million, above the consensus of analysts in the region.",
    "The board approved a dividend of [INSERT VALUE] and a buyback of up to 12 million.",
    "Regulators in <PLACE> asked for more data on the grain programme before they rule.",
    "A stop at 12 would cap the loss at [PCT CHANGE HERE] percent; the entry had been 170.89.",
    "Traders noted that %REASON% had already been priced into the options by Friday.",
    "La marge est attendue à %(margin)s % au second semestre, selon le communiqué du groupe.",
    "Inventory turned @@count@@ times, the pace suppliers had called mixed in the second quarter.",
    "Headcount at the refinery rose to <%= amount %>, and wages rose 8.9 percent.",
    "Analysts at [[region]] had expected earnings of __EPS__ per share, and the note called it modest.",
]
CONTENT = [
    None,
    "",
    " \n\t",
    "Shares of Acme Devices closed at 12.40 on Friday, a move of 3 percent on volume of 450 thousand.",
    "Access denied: that is how the judge summed up the ruling which keeps Acme out of the market.",
    "Page not found was the name of the exhibition that Acme Systems paid 9445 thousand to sponsor.",
    "An outage at the exchange left brokers with a page reading \"service unavailable\", and Acme lost 2.8 percent of its volume.",
    "Designers at Acme still fill mock-ups with lorem ipsum, but the editor wants real headlines in every test from March.",
    "The lawsuit says Acme mailed 8,670 clients a letter that began \"Dear [Name]\", a slip the firm called embarrassing.",
    "The Acme developer guide gives ${TICKER} as its example of a variable, a style engineers adopted by spring.",
    "The mail tool of Acme writes names as {{first_name}} in drafts and fills them in before sending to clients.",
    "In its set of rules {a, b, c} the index keeps Acme Mining, and [sic] the memo is quoted as written.",
    "The filing sets the payload as {\"symbol\": \"ACME\", \"qty\": 18} and the gateway rejects anything else.",
    "Rivals moved little <b>bold</b> &amp; more km² 🚀 naïve café; the company kept its gui",
    "Acme will drop its old client and require JavaScript for the trading screen, the firm told developers in spring.",
    "Acme said its ordering site answered 404 and 503 errors for 17 hours midweek and that 2906 customers were affected.",
]
FILL = [f"Acme number {i} reported revenue of {i} million for the quarter, compared with {i + 3} million a year earlier." for i in range(300)]


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(i, t, "clash") for i, t in enumerate(RESIDUE + CONTENT + FILL)]
    return {r.doc_id: r for r in residue_marks(spark.createDataFrame(rows, "doc_id long, text string, coverage string")).collect()}


@pytest.mark.parametrize("i", range(len(RESIDUE)))
def test_residue(marks, i):
    assert marks[i].residue, (RESIDUE[i], marks[i])


@pytest.mark.parametrize("i", range(len(CONTENT)))
def test_content(marks, i):
    assert not marks[len(RESIDUE) + i].residue, (CONTENT[i], marks[len(RESIDUE) + i])


def test_long_repeated_and_empty(spark):
    kind = "doc_id long, text string"
    assert residue_marks(spark.createDataFrame([], kind)).count() == 0
    article = " ".join(FILL)
    rows = [(1, article * 3), (2, article + " The price was {{price}} at last."), (None, RESIDUE[0]), (None, RESIDUE[0]), (3, "lorem ipsum dolor sit amet " * 20_000)]
    got = sorted([(r.doc_id, r.residue) for r in residue_marks(spark.createDataFrame(rows, kind)).collect()], key=str)
    assert got == sorted([(1, False), (2, True), (None, True), (None, True), (3, True)], key=str)


def test_extra_exemplars(spark):
    df = spark.createDataFrame([(1, "Zugriff nur für Abonnenten des Hauses.")] + [(10 + i, t) for i, t in enumerate(FILL)], "doc_id long, text string")
    assert residue_marks(df).filter("residue").count() == 0
    assert [r.doc_id for r in residue_marks(df, extra=[("error", "Zugriff nur für Abonnenten")]).filter("residue").collect()] == [1]


def found(text):
    """Placeholders of a text, where no word marks a mention."""
    return Matcher([x for x in exemplars() if x[0] == "placeholder"], {}, 1.0).unfilled(text)


@pytest.mark.parametrize("tag", ["*|EPS|*", "*|CLOSE_PRICE|*", "*|LIST:COMPANY NAME|*", "$$region$$", "$$company.name$$", "$$as_of$$"])
def test_merge_tags(tag):
    assert found(f"A block of shares was placed overnight at {tag} each, below the price of Friday.") == 1
    assert found(f'The letter began "Dear {tag}" and went to all clients.') == 0


def test_no_merge_tags():
    assert found("Traders who made $$ on Acme sold | held * shares, a $$$ rating, and $$ more $$ was lost.") == 0


@pytest.mark.parametrize("field", ["<ceo_name>", "<Prev_Revenue>", "<executive name>", "[dividend]", "[executive name]", "[FUND]", "[prev.revenue]", "[date of report]", "[ex_date]"])
def test_names_that_are_not_listed(field):
    assert found(f"Analysts put the payout of {field} at 12 million, a rise of 3 percent on the year.") == 1
    assert found(f'The letter began "Dear {field}" and went to all clients.') == 0


@pytest.mark.parametrize(
    "text",
    [
        "The memo is quoted as written [sic] and the tape [inaudible] ends there [emphasis added].",
        'Asked about margins, they said: "When [management] spoke to us about the order book in March, nobody had any idea of it."',
        "„Wenn [Analysten] das so sehen, dann haben sie den Auftragseingang der letzten drei Quartale nicht gelesen“, hieß es.",
        "Shares of Acme [ACME] rose, [T]he note [1] cites [the filing](http://a.b/c) and [terms](http://a.b/d).",
        "A <blockquote> and a <br /> and <dl> stay, as do <strong>bold</strong>, <acme>text</acme>, <www.acme.com> and <acme.com>.",
        "The rule holds for 3 <x and y> 4, whatever the index.",
    ],
)
def test_brackets_of_editors(text):
    assert found(text) == 0


@pytest.mark.parametrize(
    "field",
    [
        "{{ quarterly_report.company.display_name | default(issuer.legal_name) }}",
        "{{ quarterly_report.company\n   | default(issuer) }}",
        "{% if quarterly_report.company.display_name is defined and issuer.legal_name is defined %}",
        "{% if quarter\n   is defined %}",
        "<%= quarterly_report.company.display_name || issuer.legal_name || issuer.short_name %>",
        "<%= report\n.date %>",
        "[insert the full legal name of the company that issued the shares]",
        "[the full legal name of the company that issued the shares here]",
        "[your full legal name as it stands in the register of the exchange]",
    ],
)
def test_long_and_broken_fields(field):
    assert found(f"Analysts put the payout of {field} at 12 million, a rise of 3 percent on the year.") == 1


@pytest.mark.parametrize("field", ["((enter symbol))", "%PCT_CHANGE%%", "[[ region ]]", "<<amount>>", "#{total}"])
def test_signs_around(field):
    assert found(f"Analysts put the payout of {field} at 12 million, a rise of 3 percent on the year.") == 1


def test_more_labelled_placeholders(spark):
    kinds = exemplars([("placeholder", "~~FIELD~~")])
    m = Matcher([x for x in kinds if x[0] in ("placeholder", "mention")], dict.fromkeys((w for _, ws in kinds for w in ws), 5.0), 5.0)
    assert m.unfilled("The price rose to ~~price~~ on Friday.") == 1
    assert m.unfilled("The template has ~~price~~ for it.") == 0


def test_no_text_is_told_from_its_words_that_could_be_covered():
    """could_cover is never below the coverage, whatever the weights and the words set aside as a name."""
    r = random.Random(3)
    kinds = exemplars()
    vocabulary = sorted({w for kind, ws in kinds if kind != "placeholder" for w in ws})
    lines = [" ".join(sorted(ws)) for kind, ws in kinds if kind in KINDS]
    covered = 0
    for _ in range(2000):
        weights = {w: r.uniform(0.5, 12) for w in vocabulary}
        m = Matcher([x for x in kinds if x[0] in KINDS] if r.random() < 0.1 else kinds[:40], weights, r.uniform(0.5, 8))
        lead = " ".join(r.choice([r.choice(vocabulary), "acme", "holdings", "x9"]) for _ in range(r.randint(0, 6)))
        body = r.choice(lines) + r.choice([". ", " ", "\n"]) + " ".join(r.choice(["acme", "word", r.choice(vocabulary)]) for _ in range(r.randint(0, 6)))
        text = r.choice([lead + " " + body, lead + ". " + body, body])
        got = m.coverage(text)[0]
        for least in (0.3, 0.5, 0.8):
            if got >= least:
                covered += 1
                assert m.could_cover(tokens(plain(text)), least), text
    assert covered > 300


def test_a_heavy_lead_is_no_reason_to_skip(spark):
    df = spark.createDataFrame([(1, "gabarit parser mailmerge backticks. Page not found")] + [(10 + i, t) for i, t in enumerate(FILL * 10)], "doc_id long, text string")
    assert [r.doc_id for r in residue_marks(df).filter("residue").collect()] == [1]


def test_long_pointers_are_content():
    assert found("The court ruled in May [the full text of the ruling and of the dissent can be read here] for Acme.") == 0
