"""Labelled texts for the detector of personal information, composed from a small grammar and random parts.

A text is a row of sentences. A sentence is put together from lists of openings, verbs, roles, labels and endings in four
languages around slots; slots become items of personal information with their kind (capital letters) or look-alikes
without one (lower case). The wording is general: no sentence is taken from a corpus, but kinds of sentences were added
after looking at errors on documents (notes without a subject, exclusion reasons of screening, German and Spanish
look-alikes, acknowledgements with two reasons). Names, places, numbers and addresses are random. The generator is
deterministic and the number of texts is a parameter.
"""

from __future__ import annotations

import random

#: Training texts.
SAMPLE = 3_500

Item = tuple[int, int, str]

# Frequent given names and surnames of the four languages.
GIVEN = (
    "Anna Maria Laura Julia Sarah Emma Sofia Marie Paula Clara Eva Nina Lena Hannah Elena Lucia Marta Carmen Ana Isabel Rosa Pilar Claire Camille Chloe Louise Juliette Alice Emily Olivia Grace "
    "Charlotte Amelia Jessica Megan Linda Susan Karen Nancy Lisa Helen Ruth Katherine Rachel Rebecca Ingrid Ursula Petra Sabine Monika Heike Anja Silke Birgit Karin Fatima Aisha Mei Yuki Priya "
    "John James Robert Michael William David Richard Thomas Charles Daniel Matthew Mark Paul Steven Andrew George Kevin Brian Edward Peter Jack Henry Oliver Harry Oscar Leo Max Felix Lukas Jonas "
    "Jan Tim Stefan Andreas Markus Klaus Jürgen Wolfgang Hans Dieter Uwe Martin Christian Sebastian Antonio Manuel José Juan Carlos Luis Miguel Javier Pablo Diego Jorge Pedro Pierre Jean Michel "
    "Philippe Nicolas Julien Antoine Louis Hugo Marc Ahmed Omar Ali Wei Raj Ivan Olga Svetlana Giulia Marco Luca"
).split()
# Short given names, most of them ordinary words as well.
_SHORT = "Bill Bob Liz Ted Chuck Penny Nick Rose Hope Faith Ray Gene Art Drew Dale Sue Pat Will Grant Josh Kim Lee Joe Tom Sam Ben Ron Jill Amy May Joy Dan Don Ed Al Mia Ned Nell".split()
_FAMILY = (
    "Smith Johnson Brown Taylor Wilson Davies Evans Walker Wright Robinson Thompson White Hughes Green Hall Wood Harris Clark Cooper King Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker "
    "Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Zimmermann Krüger García Martínez López Sánchez Pérez Gómez Fernández Ruiz Díaz Moreno Álvarez Romero Torres Martin Bernard Dubois "
    "Durand Leroy Moreau Laurent Lefebvre Roux Fournier Girard Nguyen Chen Wang Singh Patel Khan Rossi Novak Ivanova O'Brien O’Neill McDonald"
).split()

# Parts of sentences around personal information.
_WHO = "I|We|She|He|They|You|The nurse|My sister|Our coordinator|The assistant|Somebody|One of us|The office".split("|")
_DID = (
    "asked|ask|emailed|called|call|phoned|met|told|contacted|contact|reminded|invited|informed|saw|visited|interviewed|texted|thanked|wrote to|spoke to|spoke with|talked to|talked with|heard from|waited for|"
    "worked with|work with|live with|sat with|know|knew|trust|trusted|see|met with|meet|sent this to|forwarded it to|left a message for|went to|checked with|agreed with|found|followed|helped|share an office with|spent the evening with|argued with"
).split("|")
_SAYS = (
    "said|told me|told us|told them|called|phoned|rang|wrote|writes|agreed|replied|asked|thinks|mentioned|confirmed|joined|left|helped|will|has|had|is|was|can|could|wants|works|lives|drove|promised|explained|laughed|"
    "signed|sent|gave|took|checked|came|lent me a book|never came back|also coded|read|reviewed|screened|prepared|will send|will call|is taking over|picked up|offered|showed|knows|just left"
).split("|")
_AFTER = (
    "yesterday|about the schedule|before the meeting|on Monday|again|and it helped|for an hour|about the second round|in the corridor|after work|to get the files|from the start|because of the deadline|at the clinic|"
    "last week|next month|twice|for the paper|with the forms|about this|and nobody noticed|when I was ill|this morning|about money|and was kind|, too|; we laughed a lot|, which was a relief|. It rained all day"
).split("|")
_ROLE = (
    "my supervisor|my colleague|my friend|my neighbour|my neighbor|our nurse|the interviewer|my husband|my wife|my brother|my sister|my daughter|my son|my therapist|our secretary|the coordinator|my boss|my doctor|a friend,|"
    "my manager|Nurse|Coach|nurse|sister|our trainer|the physiotherapist|my tutor|the librarian|fellow student|research assistant|the second coder|study nurse|social worker|my mother|my aunt|uncle|meine Kollegin|mein Chef|mi hermana|ma collègue"
).split("|")
_INTRO = "My name is|my name is|I am|I'm|I’m|This is|this is|It's me,|It is|Call me|call me|they call me|she is called|a man named|a woman named|Ich heiße|Mein Name ist|ich bin|Me llamo|Mi nombre es|Soy|Je m'appelle|Je suis|mon nom est|Here is|Meet".split("|")
_THANK = (
    "We thank|We would like to thank|The authors thank|The authors would like to thank|Thanks to|Thanks go to|We are grateful to|We are very grateful to|We gratefully acknowledge|Many thanks to|We are indebted to|Special thanks to|"
    "We acknowledge|I thank|I am grateful to|Wir danken|Unser Dank gilt|Agradecemos a|Nous remercions|We also thank|We wish to thank|thanks to|grateful to"
).split("|")
_FOR = (
    "for careful reading of a draft|for help with the interviews|for statistical advice|for collecting the data|for her patience|for his support|for language editing|for their comments|for help|for proofreading|for advice|"
    "for assistance in the field|who translated the items|who drew the figures|and the reading group|"
).split("|")
_GREET = "Dear|dear|Hi|hi|Hello|hello|Hey|Good morning|Good afternoon,|Good evening|Liebe|Lieber|Sehr geehrte|Sehr geehrter|Hallo|Guten Tag|Estimada|Estimado|Hola|Querida|Chère|Cher|Bonjour|My dear".split("|")
_BODY = (
    "thank you very much for the message of last week.|I hope the journey home was fine.|attached you will find what we discussed.|it was good to see you at the workshop.|vielen Dank für die Nachricht.|gracias por su mensaje.|"
    "merci pour votre message.|just a quick note on the plan.|the reviewers want one more table.|how is the new flat?|we missed you on Friday.|can we postpone?"
).split("|")
_SIGN = (
    "Best,|Best regards,|Kind regards,|Yours sincerely,|Sincerely yours,|Many thanks,|Cheers,|Mit freundlichen Grüßen|Viele Grüße|Saludos,|Atentamente,|Cordialement,|Bien à vous,|Warm wishes,|With best wishes,|Regards,|All the best,|"
    "Yours,|Take care,|Thanks again,|Warmly,|Best wishes from"
).split("|")
_FIELD = (
    "From|To|Cc|Bcc|Contact|Contact person|Name|Full name|Participant|Patient|Client|Author|Coder|First coder|Interviewer|Reviewer|Attn|Supervisor|Principal investigator|Signed|Von|An|Nombre|Nom|Corresponding author|"
    "Correspondence to|Correspondence|Address for correspondence|Reprints|Requests to|Witness|Next of kin|Emergency contact|Project lead|Transcriber|Name of participant|Consent given by|Signature"
).split("|")
_BY = "screened by|coded by|transcribed by|prepared by|checked by|approved by|signed by|entered by|translated by|reported by|completed by|interviewed by|supervised by|sent by|requested from|available from|obtained from|handed to|forwarded to|assigned to|addressed to|directed to|sent to|the interview with|a letter from|a call from|a note for|questions for|ask for|on behalf of".split("|")
_MAIL = "write to|Write to|mail|Mail|E-mail|e-mail|Email|email me at|contact|reach me at|my address is|send it to|Send comments to|correo|courriel|Kontakt|or|and|via|at|see|reply to".split("|")
_TEL = "Tel.|Tel|Phone|phone|Telephone|Mobile|mobile|Cell|Fax|Call|call|call me on|ring|ring me on|text me on|my number is|reach me on|Telefon|Handy|Tél.|Teléfono|Móvil|phone number|dial|or by phone on|under|or|at".split("|")
_LIVE = "I live at|we live at|She lives at|He moved to|They moved to|moved from|his flat at|my parents' house at|our office at|the practice at|Please send it to|please mail the letter to|post it to|Address|address|Anschrift|Adresse|Dirección|visit us at|The parcel went to|Home address|located at|wohnhaft|vive en|habite au|mailed to|delivered to|by post to".split("|")
_TOLD = "My|my|the|The|His|Her|his|her|their|with|has|holds|wrote down my|asked for my|lost my|The form shows|the card says|in the file:|under|for|Line four has|They copied my|shows|on record:|scan of".split("|")

# Labels of papers, with the form of their numbers (9 digit, X letter).
_PAPERS = [
    ("passport no.|passport number|passport|Passport No|passport #|Reisepass-Nr.|Reisepass|pasaporte|passeport n°", "X99999999|XX9999999|X99999999|99999999X|999999999"),
    ("national ID|national ID number|identity card|ID card|ID card no.|ID number|identity number|Ausweisnummer|Personalausweis|carte d'identité|ID no.|citizen number|personal identity number", "999999-9999|99999999-X|X9999999X|9999999999|99 99 99 999|XX999999X|X99999999"),
    ("DNI|NIE|NIF|DNI:|NIE no.", "99999999X|99999999-X|X9999999X"),
    ("SSN|social security number|social security no.|Social Security|número de seguridad social|numéro de sécurité sociale|Sozialversicherungsnummer", "999-99-9999|999 99 9999|99 999999 X 999|9 99 99 99 999 999 99"),
    ("health insurance number|insurance number|insurance no.|Versichertennummer|policy number|National Insurance number|NHS number|NHS no.|health card", "999 999 9999|X999999999|XX999999X|999999999|999-999-9999"),
    ("patient number|patient ID|patient no.|hospital number|MRN|medical record number|Patientennummer|case file|número de paciente", "X999.999.99|99999999|9999999|X9999999|XX-999999|999-9999|X-99999|X999.999.99"),
    ("staff no.|staff number|staff ID|employee number|employee ID|personnel number|Personalnummer|badge number|payroll number", "X-999999|999999|X99999|XX99999|99999|X-99999"),
    ("driver's licence|driving licence|driver’s license|driver's license no.|driving licence number|Führerschein|Führerscheinnummer|permiso de conducir|permis de conduire", "XX99 999999|X9999999|99999999|XX999999X|X999-9999-9999"),
]

# Subject matter of texts without personal information.
_TOPIC = (
    "anxiety|sleep|burnout|social support|pain|quality of life|well-being|adherence|perceived stress|exhaustion|grief|life satisfaction|drinking|self-efficacy|loneliness|workload|optimism|hope|trauma|coping|mood|"
    "social support|life satisfaction|sleep quality|working memory|physical activity|role strain|family income|alcohol intake|binge drinking|emotional load|exercise|memory|smoking|family conflict|hostility|fatigue|rumination|mindfulness|screen time|body image|Resilience|Stress|Depression|Coping Strategies|Job Demands"
).split("|")
_GROUP = "nurses|shift workers|dancers|older adults|carers|trainees|physicians|recruits|pregnant women|students|teachers|soldiers|farmers|all participants|the staff|the team|our colleagues|the reviewers|the librarians|patients|their families|everyone|the anonymous referees|two raters".split("|")
_STARTS = "However|Moreover|Therefore|Although|Because|After|Before|During|When|While|Since|Given|Most|Many|Some|Few|Two|Three|Both|Each|Neither|Participants|Respondents|Items|Scores|Results|Findings|Analyses|Models|Interviews|Questionnaires|Data|Limitations|Recruitment|Attrition|Measures|Women|Men|Families|Teachers|Taken together|In short|Overall|Finally|First|Second|Next|Then|Here|There|Again|Still|Later|Today|Walking|Talking|Honestly|Include|Exclude|Maybe|Code|Check|See|Compare|Possible|Unclear|Note|Version|Table|Figure|Section|Appendix|Study|Wave|Item|Response|Mean|Median".split("|")
_VERBS = "rose|fell|did not change|was measured twice|was higher in women|predicted later exhaustion|was linked to age|had to be excluded|were coded again|was unrelated to income|followed the plan|showed no trend|improved|was discussed|is needed|may help|seemed too short|was the main theme".split("|")
_HEAD = "Study Design|Statistical Analysis|Materials and Methods|Results|Discussion and Conclusion|Ethics Approval|Author Contributions|Conflict of Interest|Data Availability|Sampling Procedure|Interview Guide|Theoretical Background|Key Findings|Limitations and Outlook|Supplementary Material|Coding Scheme|Descriptive Statistics|Measurement Model|Participants and Setting".split("|")
_SCALES = "Anxiety Scale|Depression Inventory|Resilience Scale|Burnout Inventory|Questionnaire|Index|Coping Inventory|Symptom Checklist|Fatigue Scale|Strain scale|Burden Interview|Test|Sleep Index|Support Scale|Impact Scale".split("|")
_ORG = "University|University Hospital|General Hospital|Institute|Medical Center|Foundation|Research Council|College|Clinic|School District|Cohort|Health Survey|Study Group".split("|")
_GERMAN = "Die Befragten berichteten häufiger über Schlafprobleme als die Kontrollgruppe.|Der Zusammenhang zwischen Stress und Erschöpfung blieb auch nach Kontrolle von Alter und Geschlecht bestehen.|Im Interview ging es um Familie, Arbeit und Gesundheit.|Als Grenzen der Studie gelten die kleine Stichprobe und das Querschnittsdesign.|Viele Pflegekräfte nannten Zeitdruck, Schichtarbeit und fehlende Pausen.|Für die Auswertung wurden Mittelwerte und Standardabweichungen berechnet.|Insgesamt nahm die Belastung im Verlauf der Pandemie zu.|Vor allem Frauen, Studierende und Eltern kleiner Kinder waren betroffen.|Nach dem Gespräch lag der Fragebogen im Büro.".split("|")
_SPANISH = "El apoyo social se relacionó con un menor nivel de ansiedad.|Participaron estudiantes de varias facultades.|Los resultados apoyan la hipótesis principal.|La muestra fue pequeña y el diseño transversal.|Durante la pandemia aumentó el consumo de alcohol.|Según los datos, la fatiga disminuyó.".split("|")
_FRENCH = "Les participants ont rempli un questionnaire en ligne.|Le soutien social était associé à une moindre anxiété.|Cette étude présente plusieurs limites.|La fatigue a diminué après trois mois.|Selon les soignants, le travail de nuit pèse sur le sommeil.|L'analyse porte sur les réponses complètes.".split("|")
_MODIFIED = "Hohe|Höhere|Geringere|Größere|Niedrige|Soziale|Psychische|Starke|Frühere|Weitere|Mehrere|Jüngere|Gute|Chronische|Berufliche".split("|"), "Belastung|Resilienz|Stress|Unterstützung|Symptome|Werte|Erschöpfung|Beschwerden|Angehörige|Studien|Zufriedenheit|Ressourcen".split("|")
_NOTE = "wrong design|wrong population|wrong outcome|wrong setting|wrong comparator|wrong language|wrong study type|no abstract|old data|other outcome|low response|unclear dose|double entry|short report|missing values|good fit|poor match|second wave|new scale|all adults|mixed sample|open question|late reply|same cohort".split("|")
_QUESTION = "did that change anything|could you describe it|tell me about work|was that hard|is there anything else|other people then|sleep got better|feelings came back|friends mattered most|money was tight|nothing happened".split("|")
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Monday|Tuesday|Wednesday|Thursday|Friday|Easter|Christmas|English|German|Spanish|French|European|American|COVID|Internet|Google|Bayesian|Likert|Cronbach".split("|")

_ON = "b|bl|br|c|ch|cl|d|dr|f|fl|g|gl|gr|h|j|k|kl|kr|l|m|n|p|pl|pr|qu|r|s|sch|sk|st|str|t|tr|v|w|z|th|sh|".split("|")
_NU = "a|e|i|o|u|a|e|i|o|ai|au|ei|ie|ou|ea|ü|ö|ä|é|ó|y".split("|")
_CO = "n|r|l|s|t|ck|m|nd|rt|st|x|sh|lt|nk|th|d|g|v||||".split("|")


def _word(r: random.Random, most: int = 4) -> str:
    """A word that no language has."""
    w = "".join(r.choice(_ON) + r.choice(_NU) + r.choice(_CO) for _ in range(r.randint(2, most)))
    return (w if len(w) > 3 else w + "ter").capitalize()


def _given(r: random.Random) -> str:
    k = r.random()
    w = r.choice(GIVEN) if k < 0.36 else r.choice(_SHORT) if k < 0.5 else _word(r, 3)
    return w + "-" + _word(r, 2) if r.random() < 0.03 else w


def _surname(r: random.Random) -> str:
    w = r.choice(_FAMILY) if r.random() < 0.35 else _word(r)
    w = w + "-" + _word(r) if r.random() < 0.07 else w
    return r.choice(["van ", "von ", "de ", "van der ", "de la ", "Mc", "O'"]) + w if r.random() < 0.05 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


_TITLES = "Dr |Dr. |Prof. |Professor |Mr |Mr. |Mrs |Mrs. |Ms |Ms. |Miss |Herr |Frau |Sr. |Sra. |Mme |Dr. med. |Prof. Dr. ".split("|")


def _name(r: random.Random) -> tuple[str, str]:
    """Form of address in front (no item) and the name."""
    g, s, i, j = _given(r), _surname(r), r.choice("ABCDEFGHIJKLMNOPRSTVW"), r.choice("ABCDEFGHJKLMNPRST")
    title = r.choice(_TITLES) if r.random() < 0.16 else ""
    if title and r.random() < 0.6:
        return title, s
    k = r.random()
    n = f"{g} {s}" if k < 0.5 else f"{g} {i}. {s}" if k < 0.62 else f"{i}. {s}" if k < 0.74 else f"{i}. {j}. {s}" if k < 0.8 else f"{g} {_word(r)} {s}" if k < 0.85 else f"{s}, {g}" if k < 0.93 else f"{s}, {i}." if k < 0.96 else f"{s}, {g} {i}."
    style = r.random()
    return title, n.upper() if style < 0.07 else n.lower() if style < 0.15 and "," not in n and not title else n


def _email(r: random.Random) -> str:
    g, s = _given(r).lower(), _word(r).lower()
    user = r.choice([f"{g}.{s}", f"{g[0]}{s}", s, f"{s}-{g}", f"{s}_{g[0]}", f"{g}{r.randint(1, 999)}", f"{g}.{s}+list", f"{g[0]}.{s}"])
    host = r.choice(["", "", "mail.", "dept.", "students."]) + _word(r).lower() + r.choice([".com", ".org", ".net", ".edu", ".ac.uk", ".de", ".es", ".fr", "-hospital.org", ".example", ".test", ".invalid"])
    k = r.random()
    if k < 0.14:
        a, d = r.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", " dot ")])
        return f"{user.replace('.', '_')}{a}{host.replace('.', d)}"
    out = f"{user}{'(at)' if k < 0.2 else ' (at) ' if k < 0.23 else ' @ ' if k < 0.28 else '@'}{host}"
    return out.upper() if r.random() < 0.06 else out


_NUMBERS = (
    "+1-999-999-9999|+1 999 999 9999|(999) 999-9999|999-999-9999|999.999.9999|999-9999|9999999999|+44 20 9999 9999|020 9999 9999|+44 9999 999999|09999 999999|0044 (0)99 9999-9999|+49 30 9999999|+49 (0)999 99999-99|099 / 9999999|"
    "0999 9999999|0999/999 9999|0999 / 999 9999|0999-9999999|+34 999 99 99 99|999 99 99 99|+33 9 99 99 99 99|09 99 99 99 99|+999 99 999 99 99|00999 999 999 999|+999999999999|99 99 99 99|999 9999|999-9999"
).split("|")


def _phone(r: random.Random) -> str:
    out = "".join(r.choice("0123456789") if c == "9" else c for c in r.choice(_NUMBERS))
    return out + r.choice([" ext. ", ", ext. ", " ext ", " x"]) + _digits(r, r.randint(1, 4)) if r.random() < 0.12 else out


def _town(r: random.Random) -> str:
    w = _word(r)
    return r.choice(["San ", "New ", "Bad ", "Saint ", "Los ", "Upper "]) + w if r.random() < 0.12 else w + r.choice([" Falls", " am See", " Hills", " City"]) if r.random() < 0.06 else w


def _address(r: random.Random) -> str:
    n, street, town, code = r.randint(1, 1600), _word(r), _town(r), _digits(r, 5)
    street = street + " " + _word(r) if r.random() < 0.1 else street
    sep = "\n" if r.random() < 0.1 else ", "
    kind = r.choice("Road|Road|Street|Street|St.|St|Rd|Ave|Avenue|Lane|Close|Court|Drive|Way|Square|Terrace|Place".split("|"))
    uk = f"{r.choice('BLMNSWE')}{r.choice(['', 'A', 'W', 'X'])}{r.randint(1, 20)} {r.randint(1, 9)}{r.choice('ABDEFGH')}{r.choice('JLNPQRT')}"
    house = f"{n}{r.choice(['', '', '', 'a', 'B', '-' + str(n + 2)])}"
    us = f"{r.choice(['', '', 'CA ', 'NY ', 'TX ', 'IL '])}{code}"
    out = r.choice(
        [
            f"{house} {street} {kind}{sep}{town} {us}", f"{house} {street} {kind}, {r.choice(['Apt', 'Unit', 'Suite', 'Apartment'])} {r.randint(1, 40)}{r.choice(['', 'A', 'B', 'C'])}, {town} {code}", f"{house} {street} {kind}, {town}, {us}" if us != code else f"{house} {street} {kind}, {town}",
            f"Flat {r.randint(1, 40)}, {house} {street} {kind}, {town} {uk}", f"{house} {street} {kind}{sep}{town} {uk}", f"{street.split()[0]}{r.choice(['straße', 'gasse', 'str.', 'weg', 'platz', 'allee', 'strasse'])} {n % 130 + 1}{r.choice(['', '', 'a', 'b', ' c'])}{sep}{code} {town}",
            f"{n % 100 + 1}{r.choice(['', ' bis', ' ter'])}{r.choice([',', ''])} {r.choice(['rue', 'Rue', 'avenue', 'boulevard', 'place', 'chemin'])} {r.choice(['', '', 'de ', 'du ', 'de la '])}{street}{sep}{code} {town}",
            f"{r.choice(['Calle', 'Avenida', 'Plaza', 'Paseo', 'C/'])} {r.choice(['', '', 'de ', 'del '])}{street} {n % 100 + 1}{r.choice(['', ', ' + str(r.randint(1, 9)) + '.º ' + r.choice('ABC'), ', ' + str(r.randint(1, 9)) + 'º ' + r.choice('ABC')])}{sep}{code} {town}",
            f"{r.choice(['P.O. Box', 'PO Box', 'P. O. Box', 'Postfach', 'Apartado'])} {n}, {r.choice([town + ' ' + code, town + ' ' + uk, code + ' ' + town, town])}", f"{n} {street.lower()} {r.choice(['rd', 'street', 'st', 'lane', 'ave'])}{r.choice([' ', ', '])}{town.split()[0].lower()}", f"{house} {street} {kind}",
            f"{street.split()[0]}{r.choice(['straße', 'weg', 'gasse'])} {n % 90 + 1}", f"{r.choice(['Calle', 'Avenida'])} {street} {n % 90 + 1}",
        ]
    )
    return out[:-1] if out.endswith(".") else out


def _paper(r: random.Random) -> tuple[str, str]:
    """Label in front (no item) and the number."""
    labels, forms = r.choice(_PAPERS)
    number = "".join(r.choice("0123456789") if c == "9" else r.choice("ABCEHKLMPTXYZ") if c == "X" else c for c in r.choice(forms.split("|")))
    label = r.choice(labels.split("|"))
    return label + ("" if label.endswith(":") else r.choice(["", "", "", ":", " is", ", i.e."])) + " ", number


def _cite(r: random.Random) -> str:
    return "; ".join(f"{_surname(r)}{r.choice(['', ' & ' + _surname(r), ' et al.', ' and ' + _surname(r), ', ' + _surname(r) + ', & ' + _surname(r)])}, {r.randint(1985, 2025)}{r.choice(['', '', 'a'])}" for _ in range(r.randint(1, 4)))


def _known(r: random.Random) -> str:
    """A sentence with personal information, as a template."""
    c, full = r.choice, c_name(r)
    return c(
        [
            lambda: f"{c(_WHO)} {c(_DID)} {full} {c(_AFTER)}.", lambda: f"{{NAME}} {c(_SAYS)} {c(_AFTER)}.", lambda: f"{c(['Then ', 'And ', 'But ', 'Later ', 'P{n}: ', 'so ', ''])}{c(_ROLE)} {{NAME}} {c(_SAYS)} {c(_AFTER)}.",
            lambda: f"{c(['P{n}: ', '', 'Well, ', 'R: ', 'Hi, '])}{c(_INTRO)} {full}{c(['.', ', and I am {n} years old.', ' and I work in {place}.', ' from the night shift.', ', nice to meet you.'])}", lambda: f"{c(_THANK)} {{NAME}}{c([' and {NAME}', ', {NAME} and {NAME}', ', {NAME}, and {NAME}', '', ''])} {c(_FOR)}.".replace(" .", "."),
            lambda: f"{c(_GREET)} {full}{c([',', '!', ',', ''])}\n{c(_BODY)}", lambda: f"{c(_GREET)} {full}, {c(_BODY)}", lambda: f"{c(_GREET)} {c(['{GIVEN}', '{GIVEN}', full])},\n{c(_WHO)} {c(_DID)} {c(_GROUP)} {c(_AFTER)}.", lambda: f"{c(_DID).capitalize()} {full} {c(_AFTER)}{c(['.', ' ({EMAIL}).', ' ({PHONE}).', ''])}", lambda: f"{c(_DID).capitalize()} {full} ({c(['{EMAIL}', '{PHONE}'])}) {c(_AFTER)}.",
            lambda: f"{c(_THANK)} {{NAME}} {c(_FOR)} and {{NAME}} {c(_FOR)}.".replace(" .", "."), lambda: f"{{NAME}} {c(_SAYS)} {c(_AFTER)}{c(['', ', cc {EMAIL}.', ' from {PHONE}.', '.'])}", lambda: f"{c(_FIELD[:13] + _FIELD[19:])}: {{NAME}}, {{ADDRESS}}{c(['', '.', '. ' + c(_MAIL) + ' {EMAIL}'])}", lambda: f"{c(['Correspondence', 'Letters', 'Parcels', 'Requests', 'Mail'])} {c(['to', 'for', 'c/o'])} {{NAME}}, {{ADDRESS}}", lambda: f"{c(_SIGN)}\n{full}{c(['', chr(10) + '{PHONE}', chr(10) + '{ADDRESS}', chr(10) + '{EMAIL}', chr(10) + '{ADDRESS}' + chr(10) + '{PHONE}'])}\n",
            lambda: f"{c(_FIELD)}: {{NAME}}{c(['', '', ' <{EMAIL}>', ' ({EMAIL})', ', {ADDRESS}', '; {PHONE}', ', {PHONE}', ' / {EMAIL}', ', {ADDRESS}. E-mail: {EMAIL}', ', {place} ' + c(_ORG)])}{c(['', '.', chr(10)])}",
            lambda: f"{c(['Address for letters', 'Reprints', 'Further questions', 'Comments', 'Letters', 'Please write'])}{c([':', ' to', ' go to', ' should go to'])} {{NAME}}{c([', {ADDRESS}', ' ({EMAIL})', ', {EMAIL}', ', {ADDRESS}; {EMAIL}'])}.",
            lambda: f"{c(['All forms were ', 'This was ', 'The transcript was ', 'It was ', 'Data were ', ''])}{c(_BY)} {full}{c(['', ' ({EMAIL})', ' ({PHONE})', ' on {PHONE}', ' in May', ' and {NAME}'])}.", lambda: f"{{NAME}} ({c(['{EMAIL}', '{PHONE}', 'Tel. {PHONE}', 'see {EMAIL}'])}) {c(_SAYS)} {c(_AFTER)}.",
            lambda: f"{c(_MAIL)}{c([':', '', ''])} {{EMAIL}}{c(['', '.', '; ' + c(_TEL) + ' {PHONE}', ' or call {PHONE}', ', thanks', ', please'])}", lambda: f"{c(_TEL)}{c([':', '', '', '.:'])} {{PHONE}}{c(['', '.', ' or {EMAIL}', ', after six', '; {EMAIL}', ' (mornings)'])}",
            lambda: f"{c(['P{n}: ', '', 'She said: '])}{c(_LIVE)}{c([' ', ': ', ' '])}{{ADDRESS}}{c(['.', ', near the park.', ' since {year}.', ', it is loud there.', ' and I like it.', '', '!'])}", lambda: f"{c(_TOLD)} {{PAPER}}{c(['.', ' was on the list.', ' and my date of birth.', ', please delete it.', ' left the study.', ' - remove.', '', ', {ADDRESS}', ' before anything else.'])}",
            lambda: f"{c(['Consent', 'Form', 'Record', 'File', 'Sheet'])}{c([': ', ' - ', ' of '])}{{NAME}}, {{PAPER}}, {{ADDRESS}}{c(['', ']', '.'])}", lambda: f"{c(['I', 'Interviewer', 'INT', 'Moderator', 'Q'])}: {c(['Thanks', 'Thank you', 'Good', 'And', 'OK', 'Right', 'Sure', 'Welcome', 'So'])}, {{GIVEN}}{c(['.', ', what happened then?', ', please go on.', '?', ', shall we stop here?'])}",
            lambda: f"{c(['Number on the scan', 'The record holds', 'Left in the text', 'Written in the margin', 'Somebody typed'])}: {{SSN}}{c(['', '.', ', delete'])}", lambda: f"✉ {{NAME}}{c([chr(10), ' ' + chr(10), ', '])}{{EMAIL}}", lambda: f"{{NAME}}{c([', cc ', ' / ', ' - ', ', '])}{{EMAIL}}", lambda: f"{c(['cc', 'copy to', 'see'])} {{EMAIL}}.",
        ]
    )()


def c_name(r: random.Random) -> str:
    return "{GIVEN}" if r.random() < 0.3 else "{NAME}"


def _plain(r: random.Random) -> str:
    """A sentence without personal information, as a template."""
    c = r.choice
    return c(
        [
            lambda: f"{c(_STARTS)} {c(_TOPIC)} {c(_VERBS)}{c([' ({cite})', '', '', ' among ' + c(_GROUP)])}.", lambda: f"{c(_TOPIC)} {c(_VERBS)} in {c(_GROUP)} ({{cite}}).", lambda: f"{{name}}{c([' et al.', ' & {name}', ' and {name}', ''])} ({{year}}) {c(['reported', 'found', 'showed', 'proposed', 'argued', 'asked whether', 'described', 'and others studied'])} {c(_TOPIC)} and {c(_TOPIC)}.",
            lambda: f"{c(['As', 'Like', 'According to', 'Following', 'Unlike', 'See also', 'Compare', 'In line with', 'Same data as', 'cf.'])} {{name}}{c([' et al.', ' & {name}', '', ' and colleagues'])} ({{year}}), {c(_TOPIC)} {c(_VERBS)}.", lambda: f"{c(['The', 'A short form of the', 'Items of the', 'We used the', 'the'])} {{name}}{c(['', '–{name}', '-{name}'])} {c(_SCALES)} ({{cite}}) {c(['has', 'comprises', 'with'])} {{n}} items.",
            lambda: f"{c(_TOPIC).capitalize()} was measured {c(['by', 'with', 'on'])} the {{place}} {c(_SCALES)} after {{n}} weeks.", lambda: f"{c(['In', 'At', 'Near', 'From', 'Around'])} {{place}}, {c(_GROUP)} {c(_VERBS)}.", lambda: f"{c(['Data were collected in', 'The sites were', 'Fieldwork took place in', 'They came from', 'People moved from', 'We recruited in'])} {{place}}{c([' and {place}', ', {place} and {place}', ' between ' + c(_MONTHS) + ' and ' + c(_MONTHS) + ' {year}', ''])}.",
            lambda: f"The {c(['ethics board', 'ethics committee', 'review board', 'registry'])} of {{place}} {c(_ORG)} approved the {c(['study', 'protocol', 'plan'])} ({c(['no.', 'ref.', 'protocol', 'reference'])} {c(['{year}/{n}', '{n}-{year}', '{big}/{n}-A', 'EC-{year}-{n}'])}).", lambda: f"{c(['Funding came from', 'Supported by', 'This work was funded by', 'under'])} {c(['grant', 'award', 'project', 'contract', 'Grant No.'])} {c(['{n}-{n}-{big}', '{big}{n}', 'RX-{big}-{n}', 'A{big}{big}', '{big}/{year}'])}.",
            lambda: f"{c(['Registered as', 'Trial registration:', 'Preregistered,', 'registration number', 'See registry entry'])} {c(['XT', 'RBR', 'NCTX', 'OS'])}{c(['-', ''])}{{year}}{c(['-', ''])}00{{big}}.", lambda: f"{c(['ISSN', 'ISBN', 'doi:', 'DOI', 'eISSN'])} {c(['0000-{big}', '10.5555/abc.{year}.{big}', '978-0-{n}-{big}-1'])} {c(['is wrong', 'missing', 'added', ''])}.",
            lambda: f"{c(['Table', 'Figure', 'Fig.', 'Room', 'Section', 'Page', 'pp.', 'Items', 'No.', 'Record', 'record'])} {{n}}{c(['', '-{n}', ' and {n}', '.{n}'])} {c(['lists', 'shows', 'repeats', 'covers', 'has'])} {c(_TOPIC)}.", lambda: f"n = {{big}}, M = {{dec}}, SD = {{dec}}, p < .0{{n}}; {c(_TOPIC)} {c(_VERBS)}.", lambda: f"χ²({{n}}) = {{dec}}, 95% CI [-0.{{n}}, 0.{{n}}], {{big}} of {{big}} cases.",
            lambda: f"{c(['#', '##', '###', '**'])} {c(_HEAD)}\n", lambda: f"{c(_HEAD).upper()}\n", lambda: f"| {c(_TOPIC).capitalize()} | {c(_HEAD)} | {{dec}} |", lambda: c(_GERMAN), lambda: c(_SPANISH), lambda: c(_FRENCH), lambda: f"{c(['vivant à', 'habitant', 'en', 'residentes en', 'de', 'aus', 'in', 'nach', 'wohnhaft in', 'près de'])} {{place}} ({c(['moyenne', 'edad media', 'Alter', 'n', 'total'])}{c([' : ', ': ', ' = '])}{{dec}})", lambda: f"{c(_TOPIC)} and {c(_TOPIC)} {c(_VERBS)}, and {c(_TOPIC)} {c(_VERBS)}.", lambda: f"{c(_GREET)} {c(['all', 'both', 'team', 'colleagues', 'everybody', 'Sir or Madam', 'Editor', 'Reviewers', 'participants', 'friends', 'Damen und Herren', 'todos', 'tous', 'Team', 'All'])},\n",
            lambda: f"{c(_SIGN)}\n{c(['the study team', 'The Study Team', 'your project group', 'Data Office', 'the library', ''])}\n", lambda: f"{c(_THANK)} {c(_GROUP)} {c(_FOR)}.".replace(" .", "."), lambda: f"{c(_WHO)} {c(_DID)} {c(_GROUP)} {c(_AFTER)}.", lambda: f"{c(_GROUP).capitalize()} {c(_SAYS)} {c(_AFTER)}.", lambda: f"{c(_WHO)} {c(_DID)} the {{place}} {c(['office', 'site', 'group', 'clinic', 'team', 'branch', 'people'])} {c(_AFTER)}.",
            lambda: f"{c(['P{n}', 'R{n}', 'Interviewer', 'INT', 'Participant {n}', 'Speaker'])}: {c(['Well, I was tired and sad.', 'It was hard.', 'Running. Reading a bit.', 'I am fine now.', 'What changed?', 'Can you tell me more?', 'After the {place} fire we had nothing.', 'I came from {place} years ago.', 'Yes. No. Perhaps.', 'Mostly ' + c(_TOPIC) + '.', 'When did it start?'])}",
            lambda: f"{c(_MODIFIED[0])} {c(_MODIFIED[1])} {c(['führte', 'hing', 'wurde', 'bei', 'und', 'in', 'zeigten', 'nach', 'kann', 'hat', 'war'])} {c(_MODIFIED[1])}.", lambda: f"{c(_MODIFIED[0])} {c(_MODIFIED[1])} {c(['ist', 'nahm', 'geht', 'ging', 'sank', 'blieb', 'stieg'])} {c(['wichtig', 'mit der Zeit zu', 'nach drei Monaten', 'bei Frauen', 'stabil'])}.",
            lambda: f"{c(_STARTS)}: {c(_NOTE)}{c([', ', ' (', '; '])}{c(_NOTE)}{c([')', '', '.'])}", lambda: f"{c(['I', 'Interviewer', 'INT', 'Moderator', 'Q', 'P{n}', 'R'])}: {c(['And ', 'So ', 'But ', 'Well, ', '', 'Okay, ', 'Then '])}{c(_QUESTION)}{c(['?', '.'])}", lambda: f"{c(_DID).capitalize()} {c(_GROUP)} {c(_AFTER)}.", lambda: f"{c(_NOTE)} {c(_AFTER)}",
            lambda: f"{c(_GROUP).capitalize()} {c(_VERBS)}.", lambda: f"{c(_TOPIC).capitalize()} {c(['staff', 'students', 'workers', 'patients', 'load', 'levels', 'problems', 'scores'])} {c(['was', 'were', 'reported', 'showed', 'had'])} {c(_TOPIC)}.", lambda: f"{c(_TOPIC).capitalize()} {c(_SAYS)} {c(_AFTER)}.",
            lambda: f"{c(['Cronbach', 'Pearson', 'Student', 'Levene', 'Bartlett', 'Cohen', '{name}'])}{c(['’s', chr(39) + 's'])} {c(['alpha', 'test', 'r', 'kappa', 'model', 'theory', 'd'])} was {{dec}} for {c(_TOPIC)}.", lambda: f"{c(_SPANISH)} {c(_FRENCH)}", lambda: f"{c(_GERMAN)} {c(_GERMAN)}",
            lambda: f"{c(_STARTS)}: {c(_TOPIC)}{c([' drives ', ' leads to ', ' and ', ' or '])}{c(_TOPIC)}; {c(_STARTS)} {c(_TOPIC)}.", lambda: f"{c(_MONTHS)} {{n}}, {{year}}: {c(_STARTS)} {c(_TOPIC)}.", lambda: f"{c(['On', 'In', 'Since', 'Until'])} {c(_MONTHS)} {c(['{year}', '{n}', 'last year'])} {c(_TOPIC)} {c(_VERBS)}.", lambda: f"{c(['To', 'From', 'For', 'With', 'By'])} {c(_TOPIC)}{c([':', ','])} {c(_STARTS).lower()} {c(_TOPIC)}.",
            lambda: f"{c(['The', 'This', 'Our', 'No', 'One', 'Another', 'My', 'Their', 'A'])} {c(_TOPIC)} {c(_VERBS)}.", lambda: f"{{place}} {c(_ORG)} {c(_VERBS)}.", lambda: f"{c(_FIELD)}: {c(['see above', 'unknown', 'not given', 'none', c(_TOPIC), 'the team', 'n/a', 'two raters', 'missing'])}", lambda: f"{c(['Thank you', 'Thanks', 'Many thanks'])} for {c(['the data', 'your reply', 'sending the files', 'everything', 'the tables'])}.", lambda: f"@{c(['all', 'team', 'raters'])} {c(['look at', 'redo', 'see'])} {c(['items', 'lines', 'rows'])} {{big}}-{{big}}.",
        ]
    )()


def fill(template: str, r: random.Random) -> tuple[str, list[Item]]:
    """The text of a template with its slots filled, and its items."""
    out, items = "", []
    for part in template.replace("}", "{").split("{"):
        front, item, kind = "", part, ""
        if part == "NAME":
            (front, item), kind = _name(r), "person_name"
        elif part == "GIVEN":
            item, kind = _given(r), "person_name"
        elif part == "EMAIL":
            item, kind = _email(r), "email"
        elif part == "PHONE":
            item, kind = _phone(r), "phone"
        elif part == "ADDRESS":
            item, kind = _address(r), "address"
        elif part == "PAPER":
            (front, item), kind = _paper(r), "id_number"
        elif part == "SSN":
            item, kind = f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", "id_number"
        elif part == "name":
            item = _surname(r)
        elif part == "place":
            item = _town(r)
        elif part == "cite":
            item = _cite(r)
        elif part == "year":
            item = str(r.randint(1985, 2025))
        elif part == "n":
            item = str(r.randint(1, 99))
        elif part == "big":
            item = str(r.randint(100, 9999))
        elif part == "dec":
            item = f"{r.randint(0, 80)}.{r.randint(0, 99)}"
        out += front
        if kind:
            items.append((len(out), len(out) + len(item), kind))
        out += item
    return out, items


def training_texts(size: int = SAMPLE, seed: int = 9) -> list[tuple[str, list[Item]]]:
    """Texts with the places and kinds of their items."""
    r = random.Random(seed)
    texts = []
    for _ in range(size):
        text, items = "", []
        for _ in range(r.randint(2, 6)):
            part, found = fill(_known(r) if r.random() < 0.5 else _plain(r), r)
            items += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += part + ("" if part.endswith("\n") else r.choice([" ", " ", "\n", "\n\n"]))
        texts.append((text, items))
    return texts
