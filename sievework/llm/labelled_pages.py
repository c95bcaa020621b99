"""Labelled pages in five languages, one line each, ``+`` for the main body, ``=`` for what closes an article (sharing, terms of the article,
comments, further reading) and ``-`` for the rest.

They were written and labelled by hand, after the kinds of furniture that captured pages show; stock phrases of the web (a menu entry, a share
prompt, a cookie notice) therefore stand here as they stand on many pages.

``@title`` and ``@text`` stand for a title and a paragraph; training puts in titles and openings of a bounded sample of
the corpus, so the vocabulary of the body is the corpus's own. ``@cut`` is a paragraph broken off, ``@other`` another page's title and ``@blurb`` the paragraph that teases it.
"""

PAGES = [
    """
- Home
- About us
- Contact
- Press room | Guides | My account | Sign in
- [Search](/0) [Forum](/1) [Basket](/2)
- Write for us
- * Compare plans
- Setup help
- Glossary > Top lists > @title
- We use cookies and files on your device to count visits and show adverts. Choose what you allow below. Read more in our policy.
- This site and 40 partners store identifiers on your browser for statistics. You can change this at any time.
- Your visit to Sample Daily is measured with cookies so pages load faster. Continue browsing to agree.
- Accept all
- Reject all
- Only necessary
- Manage choices
- Save settings
+ @title
+ # @title
- By Ada Example
- Written by Ada Example, senior editor
- Updated 3 May 2024, 10:15 · 5120 views
+ @text
+ ## 4. Sample Name – 12.50 EUR
+ @text
+ 11. Sample Name – 9.99 €
+ @text
+ 12. Sample Name – 8.40 USD
+ 2. Sample Name – 3.15 GBP
+ @text
+ 30. Sample Name – 21.07 crowns
+ 8. Sample Name – 14.30 credits
+ 14. Sample Name – 6.55 EUR
+ @text
+ | 1 | Sample Name | 12.50 | 340 |
+ | 2 | Sample Name | 8.10 | 12 |
- Advertisement
- Compare 120 offers now
- Most read
+ - Sample Name: a long guide, 12.50
+ Sample Name: parental locks, 7.10
+ • Sample Name: profiles for children, 8.20
+ - Sample Name: radio stations, 4.40
+ Sample Name: recording for some days, 51.90
+ * Sample Name: weather, 30.00
- Get the Sample Daily letter every Friday
- Get the sample-name.example letter every Friday
- No spam, leave whenever you like.
- Enter your address
= Share this page
= Tell a friend
= Copy link
= Send by mail
= Print this article
= Post it
= 2300 comments, join the talk
- Pat52: @text
- Kim7 says @text
- Lee903 – @text
= Related reading
= You may also like
= More from Sample Daily
- › @other
- @blurb
- @other
- - @other
- @blurb
- @other
- @cut
= Prices were right when published and may have moved since. Sample Daily does not sell subscriptions.
= Sample Daily may earn a commission when you buy through links; this never changes our verdicts.
= Nothing here is legal advice. Check the rules where you live before subscribing to any service listed by sample-name.example.
- Follow Sample Daily
- Sample Daily is run by Sample Ltd, registered number 100.
- Privacy
- Terms of use
- Imprint
- © 2026 Sample Daily. All rights reserved.
- Back to top
""",
    """
- Inicio
- Quiénes somos | Ofertas | Registro
- [Buscar](/0) [Foro](/1)
- Ayuda > Guías > @title
- Guardamos archivos en su equipo para recordar sus opciones y medir visitas. Puede cambiarlo cuando quiera. Consulte la política.
- Aceptar todo
- Rechazar
- Configurar
+ == @title
+ @title
- Por Ada Ejemplo
- Escrito por Ada Ejemplo, redacción
- Actualizado el 3 de mayo de 2024, 10:15 · 5120 lecturas
+ @text
+ ### 4. Sample Name – 12.50 USD
+ @text
+ | 1 | Sample Name | 12.50 | 340 |
+ • Sample Name: perfiles infantiles, 12.50
+ Sample Name: noticias locales, 3.20
+ - Sample Name: grabación, 9.10
+ Sample Name: la guía, 41.05
- Publicidad
- Lo más leído
- Recibe el boletín de Sample Daily
- Tu correo
= Compartir
= Copiar enlace
= Imprimir
= Enviar por correo
= 230 comentarios
- Pat52 – @text
- Kim7: @text
= Más de Sample Daily
= También te puede gustar
- › @other
- @blurb
- @other
- @other
- @cut
= Los precios pueden haber cambiado desde la publicación.
= Sample Daily puede recibir una comisión por los enlaces de esta página.
- Aviso legal
- Privacidad
- © 2026 Sample Daily. Todos los derechos reservados.
""",
    """
- Accueil
- À propos | Offres | Inscription
- [Rechercher](/0) [Forum](/1)
- Aide > Guides > @title
- Ce site conserve des traceurs afin de retenir vos choix et mesurer l’audience. Vous pouvez changer d’avis. Voir notre politique.
- Tout accepter
- Tout refuser
- Paramétrer
+ # @title
+ @title
- Par Ada Exemple
- Rédigé par Ada Exemple, rédaction
- Mis à jour le 3 mai 2024, 10:15 · 5120 lectures
+ @text
+ ## 4. Sample Name – 12.50 credits
+ @text
+ | 1 | Sample Name | 12.50 | 340 |
+ * Sample Name: des profils enfants, 12.50
+ Sample Name: la météo locale, 3.20
+ • Sample Name: l’enregistrement, 8.00
+ - Sample Name: la radio, 46.30
- Publicité
- Les plus lus
- La lettre de Sample Daily
- Votre adresse
= Partager
= Copier le lien
= Imprimer
= Envoyer
= 230 commentaires
- Pat52: @text
- Kim7 – @text
= Plus sur Sample Daily
= À lire aussi
- - @other
- @blurb
- @other
- @other
- @cut
= Les prix ont pu changer depuis la parution.
= Sample Daily peut toucher une commission sur les liens de cette page.
- Mentions légales
- Confidentialité
- © 2026 Sample Daily. Tous droits réservés.
""",
    """
- Startseite
- Über uns | Angebote | Registrieren
- [Suche](/0) [Forum](/1)
- Hilfe > Ratgeber > @title
- Diese Seite speichert Daten um Besuche zu messen, damit Ihre Wahl erhalten bleibt. Sie können das jederzeit ändern. Mehr in der Erklärung.
- Wir und 40 Partner setzen Cookies um Besuche zu messen.
- Alle annehmen
- Ablehnen
- Einstellungen
+ == @title
+ @title
- Von Ada Beispiel
- Text: Ada Beispiel, Redaktion
- Stand 3. Mai 2024, 10:15 · 5120 Aufrufe
+ @text
+ ### 4. Sample Name – 12.50 crowns
+ @text
+ | 1 | Sample Name | 12.50 | 340 |
+ - Sample Name: Kinderprofile, 12.50
+ Sample Name: Regionalnachrichten, 3.20
+ • Sample Name: Aufnahme, 5.10
+ * Sample Name: Radiosender, 25.80
- Anzeige
- Meistgelesen
- Der Brief von Sample Daily
- Ihre Adresse
= Teilen
= Link kopieren
= Drucken
= Per Mail senden
= 230 Kommentare
- Pat52 – @text
- Kim7: @text
= Mehr bei Sample Daily
= Das könnte Sie interessieren
- › @other
- @blurb
- @other
- @other
- @cut
= Preise können sich seit dem Erscheinen geändert haben.
= Sample Daily erhält bei einem Kauf über Links eine Provision.
- Impressum
- Datenschutz
- © 2026 Sample Daily. Alle Rechte vorbehalten.
""",
    """
- Início
- Sobre nós | Ofertas | Registo
- [Procurar](/0) [Fórum](/1)
- Ajuda > Guias > @title
- Guardamos ficheiros no seu aparelho para lembrar as escolhas e medir visitas. Pode mudar quando quiser. Veja a política.
- Sample Daily usa cookies próprios e de 40 parceiros para medir visitas.
- Aceitar tudo
- Recusar
- Definições
+ # @title
+ @title
- Por Ada Exemplo
- Escrito por Ada Exemplo, redação
- Atualizado a 3 de maio de 2024, 10:15 · 5120 leituras
+ @text
+ ## 4. Sample Name – 12.50 GBP
+ @text
+ | 1 | Sample Name | 12.50 | 340 |
+ • Sample Name: notícias locais, 12.50
+ Sample Name: rádio, 3.20
+ - Sample Name: gravação, 7.70
+ * Sample Name: o guia, 37.15
- Publicidade
- Mais lidos
- Receba a carta de Sample Daily
- O seu correio
= Partilhar
= Copiar ligação
= Imprimir
= Enviar
= 230 comentários
- Pat52: @text
- Kim7 – @text
= Mais de Sample Daily
= Também pode gostar
- › @other
- @blurb
- @other
- @other
- @cut
= Os preços podem ter mudado desde a publicação.
= Sample Daily pode receber comissão pelas ligações desta página.
- Termos
- Privacidade
- © 2026 Sample Daily. Todos os direitos reservados.
""",
]

#: Titles and openings that stand in for ``@title`` and ``@text`` beside the corpus's own.
FILLERS = [
    ("Best guides of 2024 for a small flat: Sample Name and 12 more", "The sample box opened its menu in 40 seconds, and the picture stayed sharp. Nobody at the desk explained why a form advertised a second login for 9.50 EUR."),
    ("31 services compared in the hills: Sample Name leads", "Between March and June the number of complaints rose to 58 with no reason given. A newsletter promised a refund for the coast, which a former agent found modest."),
    ("Is Sample Name still slow in April 2025?", "Our reader answered within 12 hours and corrected the page. Two people in the city shared one account and still got the news without asking for papers."),
    ("Sample Name and frozen pictures: what a regular found", "We compared an invoice with the help page and found 30 differences, most of them about weather. Where it scored well was radio; where it failed was the guide."),
    ("Sample Name review 2023: children profiles for 12.20", "Cookies on the terms page expire after 20 days, which the panel found tidy. Paying 30.10 USD bought a long guide, a quiet ticket and wrong zones for most of the evening."),
    ("Mejores servicios 2024: Sample Name y 20 más", "Con un televisor antiguo duró 40 minutos; luego hubo una pantalla congelada. El cupón cuesta 20.10 EUR e incluye canales de radio, pero un lector notó cortes en cada prueba."),
    ("¿Es lento Sample Name en mayo?", "Según una clienta, el soporte atiende en 30 horas tras varios días. En julio el servicio pasó a la costa y quedó irregular según la factura."),
    ("Meilleurs services 2024 : Sample Name et 20 autres", "Avec un boîtier, tout marche 40 minutes puis l’image se fige. Un lecteur promet un forfait modeste à 20.10 € sans explication, et notre équipe le juge lent."),
    ("Sample Name reste-t-il cher en mai ?", "Notre équipe répond en 30 heures selon la facture. En juin, le serveur change pour la côte et reste cher à chaque essai."),
    ("Beste Anbieter 2024: Sample Name und 20 weitere", "Mit einem Tablet lief es 40 Minuten, dann kam ein Standbild. Das Paket kostet 20.10 EUR mit Aufnahme, doch ein Leser meldet Aussetzer nach einer Woche."),
    ("Ist Sample Name noch neu im Mai?", "Laut unser Team antwortet der Kundendienst in 30 Stunden. Im Juli zog das Portal nach der Küste und blieb knapp ohne Begründung."),
    ("Melhores serviços 2024: Sample Name e 20 outros", "Com um tablet durou 40 minutos; depois imagem parada. O pacote custa 20.10 EUR com gravação, mas uma cliente notou falhas em cada ensaio."),
    ("Sample Name continua caro em maio?", "Segundo um leitor, o suporte responde em 30 horas pelo mesmo preço. Em junho o servidor mudou para o vale e ficou lento sem explicação."),
]
