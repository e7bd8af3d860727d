"""Problem 9: abusive, hateful or sexual content.

Method: a weighted lexicon matched by Aho-Corasick over the folded page. Folding undoes disguises: case, accents, look-alike
letters, digits and signs for letters, letters drawn out or spelled apart, and words broken at line ends. Each topic sums
the weights of its cues within a window of text, exception phrases taken off; the highest window decides whether the topic
is present, and the sum over the page, for a thousand characters, is its score.

No cue alone is proof: an insult needs someone it is thrown at, a people called vermin needs the call or its frame,
nakedness needs a scene or an offer. So notices of doctors, farmers and animal dealers stay below the threshold.

Narrow: one pass; only page ids and topics leave a task. Defined results: null and empty pages have no topic and score 0;
repeated rows collapse; null sources are reported as one group.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import lookalike
from tidemark.llm.arrow import map_rows
from tidemark.llm.layout import reading_text

TOPICS = ("abuse", "hate", "sexual")
THRESHOLD, STRONG, WINDOW = 1.0, 0.5, 170

# Cues by topic and weight. '+' marks an open end (inflections follow); words without it are whole words.
LEXICON = """
abuse .7 bastard+ moron+ cretin+ scumbag+ imbecile+ arsehole+ asshole+ shithead+ dickhead+ wanker+ fuckwit+ bitches|son of a bitch|motherfuck+ dimwit+ halfwit+ numbskull+ blockhead+ dunce+ nitwit+
abuse .6 idiot+ fool|fools swine scum filthy pig|dirty pig|vermin like scoundrel+ wretch|liar|liars
abuse .4 filthy stinking lousy worthless goddamn damned|damn|rotten|lying|stupid|bloody|pathetic|miserable|disgusting
abuse .8 shut your|shut up you|go to hell|you stupid|you filthy|you lying|you stinking
abuse .6 could write such|choke on his own|choke on her own|choke on their own|choke on your|bunch of idiots|bunch of morons|such rubbish|his own lies|her own lies
abuse .4 you are a|you are an|like you|knows it|sits in that office|write such rubbish
abuse .7 ублюд+ мразь|мразью|мрази|подон+ мерзав+ кретин+ дебил+ сволоч+ гнида|гниды|скотина|засран+ придур+ выродок|выродк+ тварь|сучк+ сукин+ недоум+ паскуд+
abuse .6 идиот+ болван+ урод|урода|уроду|уродом|дурак+ дурень|тупиц+ негодяй+ подлец+ отребье|шваль|свинья
abuse .4 грязн+ вонюч+ лживый|лживая|лживую|ничтожн+ проклят+ поган+ жалкий|тупой|тупая|чёртов+ мерзк+
abuse .8 заткнись|заткните|пошёл вон|пошел вон|иди к чёрту
abuse .6 подавится своей|подавится|своей ложью|написать такую дрянь|такую дрянь|пусть этот
abuse .4 мог написать|вся это|и вся|это знает|только этот
abuse .7 bastard+ trottel+ schweinehund+ arschloch+ dreckskerl+ miststück+ scheißkerl+ vollidiot+ schwachkopf+ dummkopf+ hornochs+ mistkerl+ lump|lumpen|drecksau+ halunke+ schuft+
abuse .6 idiot+ schwein|schweine|esel sind sie|abschaum|gesindel
abuse .4 dreckig+ verlogen+ erbärmlich+ verdammt+ stinkend+ elend+ widerlich+ dumm+ dämlich+ jämmerlich+
abuse .8 halt das maul|halts maul|halt die fresse|halt den mund|maul du
abuse .6 solchen unsinn schreiben|solchen mist|an seinen lügen|an seinen eigenen|lügen ersticken|ersticken|solchen dreck
abuse .4 sie sind ein|du bist ein|weiß es|kann solchen|nur ein|soll an
abuse .7 bâtard+ salaud+ connard+ crétin+ ordure humaine|enfoiré+ abruti+ imbécil+ salopard+ fumier|saligaud+ fripouille+ crapule+
abuse .6 porc|cochon|idiot+ racaille|ordures
abuse .4 sale porc|sale bâtard|sale chien|sale menteur|sale racaille|ignoble+ misérable+ menteur|menteurs|puant|puante|maudit+ pitoyable+ dégoûtant+ infâme+ immonde+ minable+ répugnant+
abuse .8 ferme ta gueule|ta gueule|ferme-la|espèce de
abuse .6 étouffe avec|ses mensonges|telles ordures|écrire de telles|seul un
abuse .4 vous êtes un|tu es un|le sait|peut écrire
abuse -1.2 called the plan|a stupid waste|waste of lime|дурацкая трата|глупая трата|deplored the insults|condemned the insult|regretted the insult|осудила выкрики|осудил выкрики|осудила оскорб|bedauerte die rufe|bedauerte die beleidig|a regretté les cris|a regretté les insultes|insults shouted|pesait|livres|wog|пудов|weighed|pounds|of the fable|dans la fable|der fabel|басни|в басне
abuse .7 jackass+ you bitch|stupid bitch|whore+ slut+ fucking|fucker+ cunt+ twat+ degenerate|depp+ versager+ wichser+ hurensohn+ schlampe+ raclure+ pourriture+ salope+ putain de|мудак+ козёл|козел|козлы|гады|говню+ шлюх+ сучар+
abuse .5 loser+ jerk|jerks|coward+ clown|trash|disgrace|good for nothing|feigling+ nichtsnutz+ taugenichts|pauvre type|bon à rien|lâche|гад|хам|хамы|трус|трусы|ничтожество|бездарь
abuse .4 shame on you|you people|you should be ashamed|schämt euch|schämen sie sich|honte à vous|стыд вам|как тебе не стыдно|ты просто|вы просто
hate .7 exterminat+ wipe them out|should be shot|get rid of them all|ausrotten|ausgerottet|ausmerzen|exterminer|истребить|истребля+ уничтожить их|уничтожить всех|вырезать их
hate .6 subhumans|savages|inferior race|lower race|minderwertige rasse|race inférieure|низшая раса|низшей расы|дикари
hate .4 all of them|die ganze brut|alle diese|tous ces|all these|all those|этих всех
sexual .6 had sex|sexual act|porn+ erotic+ intercourse|masturbat+ geschlechtsverkehr|pornogra+ érotique+ porno+ порно+ эротич+ совокуплен+
sexual .4 kissed her neck|her naked|his naked|panties|garter+ corset off|undressing|zog sie aus|küsste ihren|sa chair|le lit défait|раздевал+ целовал её|целовал ее
hate .6 vermin lice|scum subhuman+ cockroach+ parasit+ maggots|mongrels|like dogs|are dogs|they are dogs|filth like|rats like|are rats|plague on
hate .7 driven out of|should be driven out|be driven out|out of our town|burn the shops|burn their|deserves the whip|deserve the whip|the whip|no decent street|decent street|hang them|gas them|beat them out
hate .4 every one of the|has room for|they are|like the|shops of the|should be driven|driven out|deserves|deserve
hate .6 вши|вшей|парази+ отребье|мразь|мрази|нелюд+ паразит+ тараканы|тараканов|сброд|шваль|нечисть|псы|собаки
hate .7 гнать их|гнать надо|гнать их надо|жгите лавки|жгите|заслуживают кнута|кнута|место на свалке|на свалке|вон из слободы|бить их|вешать их
hate .4 это отребье|ведь они|все они|таким как|заслуживают|надо из слободы|где торгуют|и гнать
hate .6 ungeziefer+ läuse|gesindel|abschaum|untermensch+ parasit+ ratten|köter|schmarotzer+ sind hunde
hate .7 vertrieben|gehören aus|zündet die läden|zündet|verdient die peitsche|peitsche|kein platz|aufhängen
hate .4 jeder der|sie sind|für gesindel|gehören|die läden|verdient|wie die|ist hier kein
hate .6 vermine|racaille|poux|parasit+ sous-hommes|soushommes|cette lie|de la lie|la lie|cafards|des chiens
hate .7 faut les chasser|les chasser de|les chasser|brûlez les boutiques|brûlez|mérite le fouet|le fouet|pas de place ici|pas de place
hate .4 chacun des|boutiques des|mérite|il faut|sont de la|place ici|ici pour la
hate -1.2 damaged the corn|corn stored|погубили зерно|зерно в слободе|fraß das korn|korn in|gâté le blé|le blé de|thanked for|благодарили|wurde für ihre spende|ont été remerciés|remercié|вши и тиф|съезде врачей|тиф|typhus|typhus discussed|were thanked|bedauerte die rufe|deplored|осудила|a regretté|insults shouted|le conseil a
sexual .5 naked nude undressed unclothed stripped bare|disrobed
sexual .4 breast+ thigh+ buttock+ bosom+ loins nipple+ hips
sexual .6 moaned|stroked her|stroked his|rutted|fornicat+ copulat+ made love|had their way|pressed his|until dawn|lewd|obscene|lust|orgasm+ postcards of|in plain cover|on the bed and|caressed her|body to hers|on the floor
sexual .5 голая|голый|голые|голую|голой|голыми|голым|нагая|нагой|нагие|нагую|нагими|раздета+ раздеты+ обнаж+ обнажены
sexual .4 груди|грудь|грудью|ляжк+ бёдра|бёдер|бёдрах|бедра|ягодиц+ соски
sexual .6 стонала|стонал|ласкал+ совокупл+ сношал+ прижался к|предавались|похоти|похоть|до рассвета|открытки с дамами|высылаем тайно|на постели и|у коих|развра+
sexual .5 nackt|nackte|nackten|nackter|nacktes|splitternackt+ splitterfasernackt+ entkleidet+ unbekleidet+ entblößt+
sexual .4 brüste|brüsten|brust|schenkel|schenkeln|hüften|hintern|busen|lenden
sexual .6 stöhnte|streichelte|liebten sich|wälzten sich|drückte sich|bis zum morgen|bilder nackter|diskret versandt|auf dem bett und|wollust|lüstern+ damen mit|unzüchtig+
sexual .5 nue|nues|tout nu|toute nue|dévêtu+ déshabillé+ dénudé+
sexual .4 seins|sein nu|cuisses|cuisse|fesses|hanches|mamelons|croupe
sexual .6 gémissait|caressait|firent l'amour|se serra|jusqu'à l'aube|s'étreignirent|étreignirent|cartes de dames|envoi discret|aux seins|gisait nue|sur le lit et|luxure|lubrique+ obscène+
sexual -1.2 lectured on|after childbirth|care of the breast|лекцию о|о болезнях|прочёл лекцию|степь|erkrankungen der|sprach über|maladies du|a parlé des|bare room|bare walls|whooping|clothed|mammary|feed the poor|medic+
"""

# What stands for a letter in disguised words.
_LATIN_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "l": "i", "ł": "i"}
_CYRILLIC_SIGNS = {"0": "о", "3": "е", "з": "е", "э": "е", "ё": "е", "4": "ч", "6": "б", "@": "а", "u": "и", "1": "и", "й": "и", "d": "д", "l": "л", "a": "а", "b": "в", "c": "с", "e": "е", "k": "к", "m": "м", "h": "н", "o": "о", "p": "р", "t": "т", "x": "х", "y": "у", "i": "и", "r": "г", "n": "п"}
_LATIN = str.maketrans(_LATIN_SIGNS)
_CYRILLIC = str.maketrans(_CYRILLIC_SIGNS)
_ACCENTS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿё", "aaaaaaceeeeiiiinooooouuuuyyе")
_MAYBE_SPELLED = re.compile(r"(?<=[ .\-_·])\w[ .\-_·]\w[ .\-_·]\w(?!\w)")
_SPELLED = re.compile(r"(?<!\w)[^\W_]([ .\-_·])[^\W_](?:\1[^\W_]){2,}(?!\w)")
_LONG = re.compile(r"(\w)\1{2,}")
#: Signs that may stand for a letter beside letters; an exclamation mark does so only between two.
_DISGUISE = re.compile(r"[0-9@$|*€](?:(?<=[^\W\d_].)|(?=[^\W\d_]))|(?<=[^\W\d_])!(?=[^\W\d_])")
_MIXED = re.compile(r"[a-z][а-яё]|[а-яё][a-z]")
_TOKEN = re.compile(r"[\w@$!|*€]+")
_CYR, _GREEK = re.compile(r"[а-яё]"), re.compile(r"[Α-ώ]")


def fold(word: str) -> str:
    """One form of a disguised word: signs and foreign look-alikes become letters of its script, letters easily taken for
    each other become one, accents are dropped."""
    return word.translate(_CYRILLIC if _CYR.search(word) else _LATIN).translate(_ACCENTS)


@functools.cache
def _lexicon() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton, dict[int, list[tuple[str, tuple]]]]:
    """Automaton of the cues as written, automaton of the folded ones, and folded words by length for starred spellings.

    The first also finds three equal letters in a row, so that drawn-out words are looked for only where there are some.
    """
    cues: dict[str, list[tuple[str, float, bool]]] = {}
    for row in LEXICON.strip().split("\n"):
        topic, weight, words = row.split(" ", 2)
        for part in words.split("|"):  # in a part with '+', words that end in it and the words between them are entries
            entries, buffer = [], []
            for w in part.split():
                if w.endswith("+"):
                    entries += [" ".join(buffer)] if buffer else []
                    entries.append(w)
                    buffer = []
                else:
                    buffer.append(w)
            entries += [" ".join(buffer)] if buffer else []
            for e in entries:
                cues.setdefault(e.rstrip("+"), []).append((topic, float(weight), e.endswith("+")))
    plain, folded = ahocorasick.Automaton(), ahocorasick.Automaton()
    by_length: dict[int, list[tuple[str, tuple]]] = {}
    for e, what in cues.items():
        for x in {e, e.translate(_ACCENTS)}:
            plain.add_word(x, (len(x), tuple(what)))
        f = _LONG.sub(r"\1", fold(e))
        if " " not in f:
            folded.add_word(f, (len(f), tuple(what)))
            for n in range(len(f), len(f) + (4 if any(o for _, _, o in what) else 1)):
                by_length.setdefault(n, []).append((f, tuple(what)))
    for c in "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïôöùûüßабвгдеёжзийклмнопрстуфхцчшщъыьэюя":
        if c * 3 not in plain:
            plain.add_word(c * 3, (3, ()))
    plain.make_automaton()
    folded.make_automaton()
    return plain, folded, by_length


def _starred(token: str) -> tuple:
    """Cues of a word with letters starred out, if such a word is in the lexicon."""
    if token.count("*") > max(1, len(token) // 3) or len(token) < 4:
        return ()
    return next((what for word, what in _lexicon()[2].get(len(token), ()) if all(c in ("*", d) for c, d in zip(token, word))), ())


def _disguised(word: str) -> tuple:
    """Cues of one disguised word."""
    f = _LONG.sub(r"\1", fold(word))
    if "*" in f:
        return _starred(f)
    hit: list = []
    for end, (m, what) in _lexicon()[1].iter(f):
        if end - m + 1 == 0:
            hit += [x for x in what if x[2] or end + 1 == len(f)]
    return tuple(hit)


def _joined(m: re.Match) -> str:
    """A word spelled apart. Where blanks part the letters, the first may be a word of its own, so both readings are given."""
    word = m.group().replace(m.group(1), "")
    return f"{word} {word[1:]}" if m.group(1) == " " else word


def cues(text: str) -> list[tuple[int, str, float]]:
    """(position, topic, weight) of all cues of a page in reading order."""
    text, mixed, _ = lookalike.repair(text)
    for at, token, repairs in reversed(mixed):
        if repairs and _GREEK.search(token):
            text = text[:at] + repairs[0] + text[at + len(token) :]
    plain = text.lower().replace("\n", " ").replace("’", "'")
    if _MAYBE_SPELLED.search(plain):
        plain = _SPELLED.sub(_joined, plain)
    out: set[tuple[int, str, float]] = set()
    n, drawn = len(plain), False
    for end, (m, what) in _lexicon()[0].iter(plain):
        if not what:
            drawn = True
            continue
        start = end - m + 1
        if start and plain[start - 1].isalpha():
            continue
        whole = end + 1 >= n or not plain[end + 1].isalpha()
        out.update((start, topic, weight) for topic, weight, open_end in what if whole or open_end)
    odd = [m.start() for m in _DISGUISE.finditer(plain)]
    if _CYR.search(plain):
        odd += [m.start() for m in _MIXED.finditer(plain)]
    if drawn:
        odd += [m.start() for m in _LONG.finditer(plain)]
    past = -1
    for at in sorted(odd):
        if at < past:
            continue
        lo = plain.rfind(" ", 0, at) + 1
        past = plain.find(" ", at)
        past = n if past < 0 else past
        for m in _TOKEN.finditer(plain, lo, past):
            out.update((m.start(), topic, weight) for topic, weight, _ in _disguised(m.group()) if weight > 0)
    return sorted(out)


def topics(text: str | None) -> dict[str, tuple[float, float]]:
    """Topic -> (highest window, sum over the page for a thousand characters), for topics with any cue."""
    out: dict[str, tuple[float, float]] = {}
    if not text:
        return out
    found = cues(text)
    if not found:
        return out
    for topic in TOPICS:
        own = [(at, w) for at, t, w in found if t == topic]
        if not own:
            continue
        best = total = 0.0
        lo = 0
        for hi, (at, w) in enumerate(own):
            while own[lo][0] < at - WINDOW:
                lo += 1
            near = [x for _, x in own[lo : hi + 1]]
            if max(near) >= STRONG:  # weak cues alone are no evidence
                best = max(best, sum(near))
            total += max(w, 0.0)
        # An exception takes off what stands around it, before and behind.
        taken = [(at, w) for at, w in own if w < 0]
        if taken and best >= THRESHOLD:
            best = 0.0
            for at, _ in own:
                near = sum(w for p, w in own if at <= p <= at + WINDOW)
                if near > best and not any(abs(p - at) < WINDOW // 2 for p, _ in taken):
                    best = near
        out[topic] = round(best, 3), round(1000 * total / max(len(text), 200), 3)
    return out


def _pages(documents: DataFrame, *more: str) -> DataFrame:
    return documents.select("doc_id", *more, "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.x1").alias("x1"), "n_columns")


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, topic), one distinct row for each topic present on a page."""

    def make():
        def each(doc, text, x0, x1, n):
            if text:
                for topic, (window, _) in topics(reading_text(text, x0, x1, n)).items():
                    if window >= THRESHOLD:
                        yield doc, topic

        return each

    return map_rows(_pages(documents).filter(F.length("text") > 0), make, "doc_id long, topic string").dropDuplicates()


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual, topics): scores for a thousand characters and the topics present; one row a page."""

    def make():
        def each(doc, source, text, x0, x1, n):
            got = topics(reading_text(text, x0, x1, n)) if text else {}
            yield doc, source, *(got.get(t, (0.0, 0.0))[1] for t in TOPICS), [t for t in TOPICS if got.get(t, (0.0,))[0] >= THRESHOLD]

        return each

    return map_rows(_pages(documents, "source"), make, "doc_id long, source string, abuse double, hate double, sexual double, topics array<string>").dropDuplicates(["doc_id"])


def rates(documents: DataFrame) -> DataFrame:
    """(source, topic, pages, flagged, rate): one row for each source and topic."""
    s = scores(documents).select("source", F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.array_contains("topics", t).cast("int").alias("hit")) for t in TOPICS))).alias("x"))
    g = s.groupBy("source", F.col("x.topic").alias("topic")).agg(F.count("*").alias("pages"), F.sum("x.hit").alias("flagged"))
    return g.withColumn("rate", F.col("flagged") / F.col("pages"))
