"""The golden questions: each must find its passage first; the control question must be refused."""

from __future__ import annotations

from groundwork.operators import fulltext, grounding, search

# Number of the question, title and content of its passage.
PASSAGES = [
    (1, "Pergunta 001 — Obrigatoriedade de Apresentação",
     "Está obrigada a apresentar a declaração quem recebeu rendimentos tributáveis acima de R$ 30.639,90."),
    (2, "Pergunta 002 — Pessoas Desobrigadas",
     "A pessoa física que não se enquadre em nenhuma das hipóteses de obrigatoriedade está dispensada."),
    (10, "Pergunta 010 — Saldo em Poupança Superior a R$ 800 mil",
     "A posse ou propriedade de bens e direitos, inclusive caderneta de poupança, com valor total superior a R$ 800.000,00 obriga à apresentação."),
    (12, "Pergunta 012 — Teto do Desconto Simplificado",
     "O desconto simplificado de 20% é limitado a R$ 16.754,34 no exercício de 2026."),
    (21, "Pergunta 021 — Prazo de Entrega IRPF 2026",
     "A Declaração de Ajuste Anual do IRPF deve ser apresentada até 30 de abril de 2026."),
    (24, "Pergunta 024 — Multa Mínima por Atraso",
     "A multa mínima por atraso na entrega da declaração sem imposto devido é de R$ 165,74."),
    (61, "Pergunta 061 — Tabela Progressiva Anual 2026",
     "A tabela progressiva anual estabelece faixas de isenção e alíquotas de 7,5%, 15%, 22,5% e 27,5%."),
    (123, "Pergunta 123 — Dedução por Dependente",
     "A dedução anual permitida por dependente na apuração da base de cálculo é de R$ 2.275,08."),
    (187, "Pergunta 187 — Previdência Complementar PGBL",
     "As contribuições para planos de previdência complementar PGBL são dedutíveis até o limite de 12% dos rendimentos tributáveis."),
    (189, "Pergunta 189 — Pensão Especial Ex-Combatente da FEB",
     "É isenta do imposto sobre a renda a pensão especial concedida a ex-combatente da Força Expedicionária Brasileira."),
    (223, "Pergunta 223 — Não Incidência sobre Pensão Alimentícia ADI 5422",
     "Em cumprimento à decisão do STF na ADI 5422, os valores recebidos a título de pensão alimentícia não estão sujeitos ao IRPF."),
    (318, "Pergunta 318 — Apostas de Quota Fixa e Bets",
     "Os prêmios líquidos obtidos em apostas de quota fixa e bets estão sujeitos à tributação exclusiva na fonte à alíquota de 15%."),
    (350, "Pergunta 350 — Dependente Filho Universitário até 24 Anos",
     "Podem ser considerados dependentes os filhos de até 24 anos que estejam cursando estabelecimento de ensino superior ou escola técnica."),
    (367, "Pergunta 367 — Prótese de Silicone em Cirurgia Médica",
     "O valor de prótese de silicone é dedutível somente se integrar a conta emitida pelo estabelecimento hospitalar."),
    (381, "Pergunta 381 — Testes de Covid Realizados em Farmácia",
     "Testes de Covid-19 realizados em farmácia não são dedutíveis como despesas médicas por ausência de previsão legal."),
    (401, "Pergunta 401 — Limite Individual de Despesas com Instrução",
     "O limite individual anual para dedução de despesas com instrução é de R$ 3.561,50."),
    (414, "Pergunta 414 — Cursos Pré-Vestibulares e Concursos",
     "Gastos com cursinhos pré-vestibulares ou preparatórios para concursos públicos não são dedutíveis da base de cálculo."),
    (473, "Pergunta 473 — Declaração Obrigatória de Criptoativos",
     "Os criptoativos e moedas virtuais devem ser declarados na ficha Bens e Direitos quando o valor de aquisição for igual ou superior a R$ 5.000,00."),
    (575, "Pergunta 575 — Isenção Ganho de Capital no Único Imóvel",
     "É isento o ganho de capital auferido na alienação do único imóvel por valor até R$ 440.000,00, desde que não tenha realizado outra alienação nos últimos 5 anos."),
    (707, "Pergunta 707 — Isenção de Ações no Mercado à Vista até R$ 20 mil",
     "São isentos do imposto de renda os ganhos líquidos auferidos em operações no mercado à vista de ações até o limite de R$ 20.000,00 por mês."),
]
# Question, and what the title of the first result must hold.
QUESTIONS = [
    ("Quem está obrigado a apresentar declaração de imposto de renda?", "Pergunta 001"),
    ("Quem é considerado desobrigado de declarar?", "Pergunta 002"),
    ("Saldo em caderneta de poupança acima de 800 mil reais obriga declaração?", "Pergunta 010"),
    ("Qual o limite do desconto simplificado na declaração?", "Pergunta 012"),
    ("Qual é o prazo final de entrega da declaração em 2026?", "Pergunta 021"),
    ("Qual o valor da multa mínima por atraso sem imposto a pagar?", "Pergunta 024"),
    ("Quais as alíquotas da tabela progressiva anual?", "Pergunta 061"),
    ("Qual o valor limite de dedução anual por dependente?", "Pergunta 123"),
    ("Qual o limite dedutível de previdência complementar PGBL?", "Pergunta 187"),
    ("A pensão de ex-combatente da FEB é isenta?", "Pergunta 189"),
    ("Pensão alimentícia ADI 5422 sofre incidência de imposto?", "Pergunta 223"),
    ("Como é tributado ganho com apostas bets de quota fixa?", "Pergunta 318"),
    ("Filho de 24 anos cursando faculdade pode ser dependente?", "Pergunta 350"),
    ("Prótese de silicone pode ser deduzida no imposto de renda?", "Pergunta 367"),
    ("Teste de covid comprado em farmácia é dedutível?", "Pergunta 381"),
    ("Qual o limite individual de dedução com despesas de instrução educação?", "Pergunta 401"),
    ("Gastos com cursinho pré-vestibular e concurso são dedutíveis?", "Pergunta 414"),
    ("Como declarar criptoativos e Bitcoin na ficha de bens?", "Pergunta 473"),
    ("Venda do único imóvel até 440 mil reais tem isenção de ganho de capital?", "Pergunta 575"),
    ("Alienação de ações no mercado à vista até 20 mil reais no mês é isenta?", "Pergunta 707"),
]
CONTROL = "Qual a alíquota de ICMS sobre combustíveis no estado de São Paulo?"


def found(spark):
    chunks = spark.createDataFrame(
        [(n, 1, title, content) for n, title, content in PASSAGES], "chunk_id int, document_id int, title string, content string")
    asked = [(n, query) for n, (query, _) in enumerate([*QUESTIONS, (CONTROL, "")])]
    questions = spark.createDataFrame(asked, "query_id int, query string")
    results = search.hybrid_search(questions, chunks, fulltext.Vocabulary())
    return questions, search.with_sources(results, chunks)


def test_golden_questions_find_their_passage_first(spark):
    questions, results = found(spark)
    first = {r.query_id: r.title for r in results.where("rank = 1").collect()}
    missed = [query for n, (query, title) in enumerate(QUESTIONS) if title not in first.get(n, "")]
    assert not missed
    judged = results.withColumnRenamed("vector_similarity", "similarity").withColumnRenamed("full_text_match", "full_text_match")
    grounded = {r.query_id: r.grounded for r in grounding.is_grounded(questions, judged).collect()}
    assert not grounded[len(QUESTIONS)]
