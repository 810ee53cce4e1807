"""Sentences written by hand, apart from the rule that trains the model; ``<kind:value>`` marks personal data, everything else is none."""

SENTENCES = """
Dr. Miller's practice moved; the new phone is <local_phone:(030) 555-0142>, ask for Anna.
If nobody answers, ring the night desk: <local_phone:0207 946 0018>.
Our reception has a telephone number, <local_phone:555-867-5309>, that works on weekdays.
Bitte anrufen unter <local_phone:030/2345678> oder eine Mail schreiben.
Rufnummer der Praxis: <local_phone:0171-5550-1234>, werktags bis 17 Uhr.
Pour nous joindre : téléphone <local_phone:01 44 55 66 77> le matin.
Mi teléfono es <local_phone:091 555 4321>, llámame por la tarde.
Fax <local_phone:0221 998 7654> is only read on Mondays.
She lists her mobile as <local_phone:415.555.2671> on the web site.
Kontakt über Handy <local_phone:0160 555 98 76> möglich.
My landlord wants the rent on account <account:DE89370400440532013000> by Friday.
IBAN <account:GB29 NWBK 6016 1331 9268 19> (Example Bank).
Virement sur <account:FR1420041010050500013M02606>, merci.
Überweisung bitte auf <account:DE75 5121 0800 1245 1261 99> mit Namen.
La transferencia va a la cuenta <account:ES9121000418450200051332>.
The bank confirmed <account:NL91ABNA0417164300> as ours.
His social security number, <identity:219-09-9999>, was printed on the card.
SSN <identity:078-05-1120> belongs to the patient in room 4.
Write to jane <masked_email:jane.roe [at] example.com> for the slides.
Contact: <masked_email:office(at)example.org>, we answer within a day.
Mail an <masked_email:info [at] beispiel [dot] de> genügt.
The host <ip6:2001:0db8:85a3:0000:0000:8a2e:0370:7334> refused the login.
Server <ip6:fe80:0:0:0:202:b3ff:fe1e:8329> went down at night.
The patient, born <birth:1984-03-12>, came alone.
Geboren am <birth:07.11.1962> in Köln, lebt er heute in Rom.
Date of birth <birth:03/09/1991>, place of birth Leeds.
Née le <birth:14.07.1975> à Lyon.
Fecha de nacimiento: <birth:21/02/1988>.
Her birthday, <birth:1990-12-01>, is in the file.
Mail für Jürgen: <email_like:jürgen@beispiel.de> bitte kopieren.
The defanged address was <ip_like:203[.]0[.]113[.]7> in the report.
We blocked server <ip_like:198[.]51[.]100[.]23> yesterday.
My credit card is <card_like:4111.1111.1111.1111>, please charge it.
Kreditkarte <card_like:5500.0000.0000.0004> läuft bald ab.
Call <phone_like:0049 30 1234 5678> from abroad.
Téléphone : <phone_like:0033 1 44 55 66 77>.
The order 4711-2290 left the house in 12 boxes of 250 pieces.
Pages 120-134 and 201-215 describe the method in full.
Version 10.4.2 replaces 10.3.11 and fixes 27 faults.
ISBN 978-3-16-148410-0 is the second edition.
The price fell from 1200-1400 to 900-1000 within a year.
Between 1914-1918 and 1939-1945 the mill stood still.
The match ended 21-19, 17-21, 21-15 after two hours.
Tracking number 123-45-6789 was scanned in Lyon.
Part 555-12-3456 fits the older model only.
Model DX12 3456 7890 1234 is out of stock.
SKU AB12 0000 1111 2222 3333 was counted twice.
At 12:45:30 the train left, and at 13:05:10 it came back.
A ratio of 16:9:4 was used for the panels.
The law was published on 23.05.1949 and changed in 1990.
Last updated 2021-06-30 by the editors.
Release 2019-04-11 brought the new menu.
Invoice of 12/31/2019: total 1,299.00 for 3 items.
Stand 01.01.2020, alle Preise in Euro.
Facture du 05/06/2018, page 3 sur 7.
Order number 4000 1234 5678 9010 9 was cancelled.
Serial 1234567890123456 is engraved below.
The file @home has 300 lines, user@12 has none.
Room 101.22.3 is on the third floor of building 7.
Add 250 ml at 20 degrees, stir 10-15 minutes, rest 30-45.
Chapter 12 14 16 cover the rest of 2021 2022 2023.
The score was 100-98 110-102 in overtime.
Ticket 0012 445-9981 is closed.
Coordinates 52.5200 13.4050 mark the gate.
Des pages 12/34 et 56/78 manquent.
Pedido 2020-10-05 enviado con 3 artículos.
The draft had 5000 words, 12.5 percent more than 4444.
"""


def cases() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, its marked spans)."""
    import re

    out = []
    for line in SENTENCES.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"<([a-z_0-9]+):([^>]*)>", line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
