"""SC14-SC16, SET6: skills named in a text, by a dictionary of names with other spellings."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, functions as F

from postgrove.functions.text import normalized
from postgrove.functions.urls import let

# Skills, each with its other spellings.
SKILLS = [
    ["Java"], ["Python"], ["JavaScript", "js"], ["TypeScript", "ts"], ["C++", "cpp"], ["C#", "csharp", "c sharp"], ["C"], ["Go", "golang"], ["Rust"], ["Ruby"], ["PHP"], ["Swift"],
    ["Kotlin"], ["Objective-C"], ["Scala"], ["Dart"], ["R"], ["MATLAB"], ["Perl"], ["Shell", "bash", "shell scripting"], ["PowerShell"], ["SQL"], ["HTML"], ["CSS"], ["Sass", "scss"],
    ["Solidity"], ["VBA"], ["Assembly"], ["React", "reactjs"], ["Next.js", "nextjs"], ["Angular", "angularjs"], ["Vue", "vuejs"], ["Svelte"], ["Redux"], ["jQuery"], ["Bootstrap"],
    ["Tailwind CSS", "tailwind"], ["Material UI", "mui"], ["Webpack"], ["Vite"], ["Three.js", "threejs"], ["React Native"], ["Flutter"], ["Ionic"], ["jQuery UI"], ["Figma"], ["Adobe XD"],
    ["Photoshop"], ["Illustrator"], ["Spring Boot", "springboot"], ["Spring"], ["Hibernate"], ["Node.js", "nodejs", "node"], ["Express.js", "expressjs", "express"], ["NestJS"], ["Django"],
    ["Flask"], ["FastAPI"], ["Ruby on Rails", "rails"], ["Laravel"], ["ASP.NET", "aspnet"], [".NET", "dotnet"], ["GraphQL"], ["REST API", "rest apis", "rest", "restful"], ["gRPC"],
    ["Microservices"], ["WebSockets", "websocket"], ["Socket.IO", "socketio"], ["JWT"], ["OAuth"], ["Servlets"], ["JSP"], ["Maven"], ["Gradle"], ["JUnit"], ["Mockito"],
    ["MongoDB", "mongo"], ["PostgreSQL", "postgres", "psql"], ["MySQL"], ["SQLite"], ["Oracle"], ["SQL Server", "mssql"], ["Redis"], ["Cassandra"], ["DynamoDB"], ["Elasticsearch"],
    ["Firebase"], ["Supabase"], ["Neo4j"], ["Prisma"], ["Mongoose"], ["Snowflake"], ["BigQuery"], ["Redshift"], ["AWS", "amazon web services"], ["Azure"], ["Google Cloud", "gcp"],
    ["Docker"], ["Kubernetes", "k8s"], ["Terraform"], ["Ansible"], ["Jenkins"], ["GitHub Actions"], ["GitLab CI"], ["CI/CD", "cicd", "ci cd"], ["Linux"], ["Nginx"],
    ["Apache Kafka", "kafka"], ["RabbitMQ"], ["Serverless"], ["Lambda", "aws lambda"], ["EC2"], ["S3"], ["Prometheus"], ["Grafana"], ["Datadog"], ["Machine Learning", "ml"],
    ["Deep Learning"], ["TensorFlow"], ["PyTorch"], ["Keras"], ["scikit-learn", "sklearn"], ["Pandas"], ["NumPy"], ["OpenCV"], ["NLP", "natural language processing"], ["Computer Vision"],
    ["Data Analysis", "data analytics"], ["Data Science"], ["Power BI", "powerbi"], ["Tableau"], ["Excel"], ["Apache Spark", "spark"], ["Hadoop"], ["Airflow"], ["ETL"],
    ["LLM", "large language models"], ["Generative AI", "gen ai", "genai"], ["Git"], ["GitHub"], ["GitLab"], ["Jira"], ["Agile"], ["Scrum"],
    ["DSA", "data structures and algorithms", "data structures"], ["Algorithms"], ["OOP", "object oriented programming"], ["System Design"], ["DBMS"], ["Operating Systems"],
    ["Computer Networks", "networking"], ["Unit Testing"], ["Selenium"], ["Cypress"], ["Jest"], ["Playwright"], ["Postman"], ["Manual Testing"], ["Automation Testing", "test automation"],
    ["SEO"], ["Digital Marketing"], ["Content Writing"], ["Canva"], ["Android"], ["iOS"], ["Unity"], ["Blockchain"], ["Cybersecurity", "cyber security"], ["Penetration Testing"],
]


def parts_of(spelling: str) -> list[str]:
    """A spelling's parts in small letters: runs of letters, digits, + and #."""
    return [p for p in re.split("[^a-z0-9+#]+", spelling.lower()) if p]


def forms_of(spelling: str) -> list[str]:
    """All ways in which the parts may stand in a normalised text: with a space or nothing between two of them."""
    parts = parts_of(spelling)
    return [parts[0] + "".join(gap + p for gap, p in zip(gaps, parts[1:])) for gaps in product((" ", ""), repeat=len(parts) - 1)]


def name_by_form() -> dict[str, str]:
    """The skill that a form names; the first in the list has it."""
    found: dict[str, str] = {}
    for name, *others in SKILLS:
        for spelling in (name, *others):
            for form in forms_of(spelling):
                found.setdefault(form, name)
    return found


def names_by_form() -> list[tuple[str, str]]:
    """(form, name) of every skill, also where two share a form."""
    return [(form, entry[0]) for entry in SKILLS for form in dict.fromkeys(f for spelling in entry for f in forms_of(spelling))]


def found_skills(text: Column) -> Column:
    """SC15 before subsumption: names in the dictionary's order. Only forms whose first part is a word of the text are looked for in it."""
    forms = F.array(*[F.struct(F.lit(form.split(" ")[0]).alias("first"), F.lit(f" {form} ").alias("form"), F.lit(name).alias("name")) for form, name in names_by_form()])
    firsts = F.array(*[F.lit(w) for w in sorted({form.split(" ")[0] for form, _ in names_by_form()})])

    def look(low: Column) -> Column:
        words = F.array_intersect(F.split(low, " "), firsts)
        return let(words, lambda w: F.array_distinct(F.transform(F.filter(forms, lambda f: F.array_contains(w, f["first"]) & F.concat(F.lit(" "), low, F.lit(" ")).contains(f["form"])), lambda f: f["name"])))

    return let(normalized(text), look)


def drop_subsumed(skills: Column) -> Column:
    """A skill goes if a longer one that was found holds its name: Java beside JavaScript, Git beside GitHub."""
    return F.filter(skills, lambda a: ~F.exists(skills, lambda b: (F.length(b) > F.length(a)) & F.lower(b).contains(F.lower(a))))


def extract_skills(text: Column) -> Column:
    """SC15."""
    return drop_subsumed(found_skills(text))


def canonical_skill(value: Column) -> Column:
    """SC16: the dictionary's name of a spelling, null if it has none."""
    names = F.create_map(*[F.lit(x) for pair in name_by_form().items() for x in pair])
    low = F.lower(F.trim(value))
    return F.when(low.rlike("^[a-z0-9+#](?:.*[a-z0-9+#])?$"), F.element_at(names, normalized(low)))


def skill_list(values: Column) -> Column:
    """SET6: canonical where known, each once in any case, first spelling first."""
    names = F.transform(F.filter(values, lambda v: F.trim(v) != ""), lambda v: F.coalesce(canonical_skill(v), F.trim(v)))
    return F.filter(names, lambda v, i: F.array_position(F.transform(names, F.lower), F.lower(v)) == i + 1)
