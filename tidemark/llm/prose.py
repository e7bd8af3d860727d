"""Seed prose, written for this project, from which the per-language zstandard dictionaries are trained."""

PROSE = {
    "ru": """Настоящее положение определяет порядок хранения, учёта и выдачи документов в учреждении. Начальник отдела подписал
приказ о назначении ответственного лица и передал его в канцелярию. Комиссия рассмотрела заявление, проверила сведения и составила
протокол в двух экземплярах. Сотрудник службы снабжения получил накладную, сверил остатки на складе и внёс запись в журнал. После
проверки оборудования инженер обновил график работ и направил отчёт руководителю. В соответствии с договором поставщик обязан вернуть
груз до конца месяца. Согласно инструкции ключ от помещения сдаётся дежурному под роспись. На основании распоряжения председателя
собрание утвердило смету расходов на ремонт здания. Заведующий приложил к письму копию ведомости и перечень имущества. Приёмная
зарегистрировала обращение, указала номер и дату, поставила печать. Сводка по участкам составлена за третий квартал прошлого года.
Показания приборов признаны достоверными, замечания устранены, срок продлён. Памятка для сторожей вывешена у входа. Старший мастер
отклонил заявку, потому что таблица норм расхода топлива не была приложена. Архивная группа опечатала дела постоянного хранения.
Читайте также новые поступления раздела, подпишитесь на рассылку, поделитесь ссылкой. Все права сохранены, перепечатка запрещена.
Жители города благодарили врачей и учителей за помощь. Молодой человек вышел из дома рано утром и пошёл по улице к реке. Ветер стих,
снег перестал, и вскоре показалось солнце. Мать сказала, что дети давно спят и будить их не надо. Он долго думал, прежде чем ответить
на этот вопрос. Книга лежала на столе рядом с лампой, окно было открыто. Если погода позволит, завтра поедем в лес за грибами.
Государственный надзор осуществляется органами исполнительной власти. Техническое обслуживание насоса, весов и счётчиков проводится
ежемесячно. Экспертная коллегия приостановила действие регламента до начала следующей смены. Предприятие обеспечивает сохранность,
безопасность и качество продукции. Формы отчётности, положения, приказы, письма, регламенты, инструкции, сводные отчёты и акты осмотра
хранятся в архиве. Без изменений, пункт, раздел, страница, приложение, ответ на запрос, положение о складе, перечень пломб.""",
    "en": """The office keeps a register of letters, orders and reports. The manager signed the agreement and sent a copy to the
branch. Please return the form before Friday. The water pump failed after three hours and the engineers closed the valve. Who took the
key from the desk? He said that the train would be late because of the snow. Shelves, lamps and ropes were sold at the market. She walked
along the river until the evening and read an old book by the window. Every member of the committee must answer the question in writing.
This page was printed from the archive; all rights reserved. Share this page by mail, print or link. See figure and section for details.""",
    "de": """Die Verwaltung führt ein Verzeichnis der Briefe, Anordnungen und Berichte. Der Leiter unterschrieb den Vertrag und schickte
eine Abschrift an die Zweigstelle. Bitte geben Sie das Formular bis Freitag zurück. Das Lager blieb wegen der Prüfung geschlossen. Wer
hat den Schlüssel vom Tisch genommen? Er sagte, der Zug werde wegen des Schnees später kommen. Schrauben, Seile und Kisten fehlten. Sie
ging am Fluss entlang und las ein altes Buch am Fenster. Über die Brücke fährt täglich ein großer Wagen für die Bürger der Stadt.""",
    "fr": """Le bureau tient un registre des lettres, des ordres et des rapports. Le directeur a signé le contrat et envoyé une copie à
la succursale. Veuillez renvoyer le formulaire avant vendredi. Le dépôt reste fermé à cause du contrôle. Qui a pris la clé sur la table ?
Il a dit que le train serait en retard à cause de la neige. Les caisses et les cordes ont été vendues. Elle marchait le long de la rivière
et lisait un vieux livre près de la fenêtre. Le camion est déjà parti, l'ingénieur a réparé le pont à l'entrée de la ville où naît le fleuve.""",
    "zh": """本办公室保存信件、命令和报告的登记册。经理签署了合同，并把副本寄给分公司。请在星期五之前交回表格。仓库因检查而关闭。谁拿走了桌上的钥匙？
他说火车会因为下雪晚点。货物共有几十箱，其中一些破损。水泵运行了三个小时，没有异常。旅客改走陆路，渡口停航。明天再来吧，太晚了。门卫说请等一下。检查结果见第几页。
重新开放的时间是八月。她沿着河边散步，在窗边读一本旧书。""",
}
