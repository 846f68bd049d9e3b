"""Lines written by hand, in four languages: (line, the personal data that it holds as (kind, text))."""

LINES = [
    ("Write to anna.kern (at) example (dot) org before noon.", [("email", "anna.kern (at) example (dot) org")]),
    ("You can reach me: j.smith [at] mail [dot] example [dot] com", [("email", "j.smith [at] mail [dot] example [dot] com")]),
    ("Send it to bob@example.com, please.", [("email", "bob@example.com")]),
    ("My number is (415) 555-0134, call after six.", [("phone", "(415) 555-0134")]),
    ("Call 415-555-0176 or come by.", [("phone", "415-555-0176")]),
    ("Ring +44 20 7946 0958 for the desk.", [("phone", "+44 20 7946 0958")]),
    ("The server answered from 192.168.10.4 all night.", [("ip", "192.168.10.4")]),
    ("Peer 2001:db8:85a3:0:0:8a2e:370:7334 went away.", [("ip", "2001:db8:85a3:0:0:8a2e:370:7334")]),
    ("Route via 2001:db8::1 failed twice.", [("ip", "2001:db8::1")]),
    ("Paid with 4111 1111 1111 1111 last week.", [("card", "4111 1111 1111 1111")]),
    ("We met at noon, at the dot of the old map.", []),
    ("Version 2.10.3 came out on 2021-03-04.", []),
    ("See pages 120-134 and 200-215 of volume 3.", []),
    ("The score was 3-2 at half time and 5-4 later.", []),
    ("Order 2021-000417 was shipped on 12/04/2021.", []),
    ("Prices rose from 1,200.50 to 1,350.75 in a year.", []),
    ("Look at sample dot matrix printers at the fair.", []),
    ("At 10:30 and 11:45 the trains leave for Bath.", []),
    ("The ratio 12:34:56 is no time of day here.", []),
    ("Room 415, floor 5, building 55.", []),
    ("Schreiben Sie an max.muster (at) beispiel (dot) de bis Freitag.", [("email", "max.muster (at) beispiel (dot) de")]),
    ("Kontakt: lena [at] verein [dot] example [dot] org", [("email", "lena [at] verein [dot] example [dot] org")]),
    ("Rufen Sie +49 30 901820 an.", [("phone", "+49 30 901820")]),
    ("Meine Nummer ist (030) 901-8200, abends.", [("phone", "(030) 901-8200")]),
    ("Der Rechner 10.20.30.40 war nicht erreichbar.", [("ip", "10.20.30.40")]),
    ("Die Adresse 2001:db8:1:2:3:4:5:6 gehört zum Büro.", [("ip", "2001:db8:1:2:3:4:5:6")]),
    ("Karte 5500-0000-0000-0004 wurde belastet.", [("card", "5500-0000-0000-0004")]),
    ("E-Mail: post@verein.example", [("email", "post@verein.example")]),
    ("Am 12.03.2021 um 14:30 Uhr begann die Sitzung.", []),
    ("Paragraf 12 Absatz 3 Satz 4 gilt nicht.", []),
    ("Die Strecke misst 120-130 Kilometer.", []),
    ("Das Buch hat 312 Seiten, ISBN 978-3-16-148410-0.", []),
    ("Der Zug 415 fährt von Gleis 5 um 5.55 Uhr.", []),
    ("Er wohnt at home, wie man sagt.", []),
    ("Rechnung 2020-4711-03 vom Mai.", []),
    ("Version 10.4 ersetzt Version 10.3.", []),
    ("Écrivez à marie.dupont (at) exemple (dot) fr avant lundi.", [("email", "marie.dupont (at) exemple (dot) fr")]),
    ("Mon adresse : paul [at] courrier [dot] exemple [dot] org", [("email", "paul [at] courrier [dot] exemple [dot] org")]),
    ("Appelez le +33 1 70 18 99 00 demain.", [("phone", "+33 1 70 18 99 00")]),
    ("Son numéro : (212) 555-0145, le soir.", [("phone", "(212) 555-0145")]),
    ("Le serveur 172.16.254.1 ne répond plus.", [("ip", "172.16.254.1")]),
    ("La machine 2001:db8::ff00:42:8329 est en panne.", [("ip", "2001:db8::ff00:42:8329")]),
    ("Carte 4012 8888 8888 1881 refusée.", [("card", "4012 8888 8888 1881")]),
    ("Contact : bureau@association.example", [("email", "bureau@association.example")]),
    ("Le 14/07/2021 à 18h30, place du marché.", []),
    ("Les pages 45-67 du tome 2 manquent.", []),
    ("La version 3.2.1 corrige 14 erreurs.", []),
    ("Le train 6607 part à 6:07 de la voie 7.", []),
    ("Il a gagné 6-4, 3-6, 7-5 en deux heures.", []),
    ("Facture 2021-0042 du 3 mai.", []),
    ("Le total est de 1.234,56 euros.", []),
    ("Le dot final at la fin de la phrase.", []),
    ("Escriba a luis.perez (at) ejemplo (dot) es antes del lunes.", [("email", "luis.perez (at) ejemplo (dot) es")]),
    ("Mi correo: ana [at] buzon [dot] ejemplo [dot] com", [("email", "ana [at] buzon [dot] ejemplo [dot] com")]),
    ("Llame al +34 91 123 45 67 mañana.", [("phone", "+34 91 123 45 67")]),
    ("Mi número es (305) 555-0199, por la tarde.", [("phone", "(305) 555-0199")]),
    ("El servidor 10.0.0.254 no responde.", [("ip", "10.0.0.254")]),
    ("El equipo 2001:db8:0:0:1:0:0:1 está apagado.", [("ip", "2001:db8:0:0:1:0:0:1")]),
    ("Tarjeta 4222 2222 2222 2220 aceptada.", [("card", "4222 2222 2222 2220")]),
    ("Contacto: oficina@asociacion.example", [("email", "oficina@asociacion.example")]),
    ("El 12/10/2021 a las 20:30 en la plaza.", []),
    ("Las páginas 12-34 del tomo 5 faltan.", []),
    ("La versión 4.5.6 sale en mayo.", []),
    ("El autobús 555 sale a las 15:55.", []),
    ("Ganó 6-3 y 7-6 en la final.", []),
    ("Pedido 2021-3344-55 del martes.", []),
    ("Son 1.500,75 euros en total.", []),
    ("El punto at final de la frase dot.", []),
]
