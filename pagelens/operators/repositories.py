"""What a repository is made with, by the presence and the text of its files: a row for each file goes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Files and folders that tell a site generator or a build step.
HUGO_FILES = "hugo.toml hugo.yaml hugo.yml".split()
HUGO_PERHAPS = "config.toml config.yaml config.yml".split()
HUGO_FOLDERS = "content layouts themes archetypes static assets data i18n config/_default".split()
NEXT_BUILT = [
    "_next/static/chunks/_buildManifest.js", "_next/static/chunks/_ssgManifest.js", ".next/BUILD_ID", ".next/routes-manifest.json",
    "out/_next/static/chunks/_buildManifest.js", "out/_next/static/chunks/_ssgManifest.js",
]
BUILD_FILES = (
    "package.json Gemfile _config.yml config.toml config.yaml hugo.toml hugo.yaml gatsby-config.js gatsby-config.ts next.config.js "
    "next.config.mjs nuxt.config.js nuxt.config.ts astro.config.mjs svelte.config.js vite.config.js vite.config.ts webpack.config.js "
    "rollup.config.js eleventy.config.js .eleventy.js mkdocs.yml docusaurus.config.js pelican.py pelicanconf.py"
).split()
BUILD_FOLDERS = "node_modules _layouts _includes _posts _sass archetypes layouts themes scaffolds source/_posts .next .nuxt .gatsby-cache".split()


def frameworks(files: DataFrame, repo: str) -> DataFrame:
    """repo and frameworks, in a fixed order: those whose rules a repository's files (repo, path, content) meet; Static
    HTML only if there is no other, with an index.html at the top and no build files or folders.

    One aggregation with map-side combining; contents are looked at where they are read.
    """
    path, text = F.col("path"), F.lower(F.coalesce("content", F.lit("")))
    has = lambda *needles: [F.contains(text, F.lit(n)) for n in needles]
    name, top = F.substring_index(path, "/", -1), ~F.contains(path, F.lit("/"))
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))

    def below(folders: list[str]) -> Column:
        return path.rlike("^(?:" + "|".join(f.replace(".", "\\.") for f in folders) + ")/")

    def both(*cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out & c
        return out

    def either(*cs: Column) -> Column:
        out = cs[0]
        for c in cs[1:]:
            out = out | c
        return out

    index, generator = name == "index.html", F.contains(text, F.lit('name="generator"'))
    manifest = path.rlike("^(?:[^/]+/)?package\\.json$")
    listed = lambda p: F.get_json_object("content", f"$.dependencies['{p}']").isNotNull() | F.get_json_object("content", f"$.devDependencies['{p}']").isNotNull()
    rules = {
        "Hexo": any_((path == "index.html") & F.contains(text, F.lit("hexo"))),
        "Jekyll": any_(path.isin("Gemfile", "_config.yml") & F.contains(text, F.lit("jekyll"))),
        "Hugo": any_(either(index & either(both(generator, *has("hugo")), *has("powered by hugo")), (name == "index.xml") & both(*has("<generator>", "hugo")), path.isin(HUGO_FILES)))
        | (any_(path.isin(HUGO_PERHAPS)) & any_(below(HUGO_FOLDERS))),
        "React": any_(manifest & ~listed("next") & listed("react") & listed("react-dom")),
        "Next.js": any_(path.isin(NEXT_BUILT) | (manifest & listed("next"))),
        "Express": any_(manifest & listed("express")),
        "Vue": any_(manifest & listed("vue") & ~listed("nuxt")),
        "Pelican": (any_(path == "pelicanconf.py") & any_(path == "publishconf.py"))
        | any_(either(path.isin("requirements.txt", "README.md", "README.rst", "README.txt") & F.contains(text, F.lit("pelican")), index & either(both(generator, *has("pelican")), *has("powered by pelican")))),
        "Quarto": any_(path.isin("_quarto.yml", "_quarto.yaml") | (index & either(both(generator, *has("quarto")), *has("quarto-html", "quarto-nav")))),
        "Flask": any_(((path == "app.py") & either(*has("flask(__name__)", "app = flask"))) | (path.isin("requirements.txt", "pyproject.toml") & F.contains(text, F.lit("flask")))),
    }
    static = any_(path == "index.html") & ~any_((top & path.isin(BUILD_FILES)) | below(BUILD_FOLDERS))
    x = files.groupBy(repo).agg(*[c.alias(k) for k, c in rules.items()], static.alias("static"))
    named = F.array_compact(F.array(*[F.when(F.col(f"`{k}`"), F.lit(k)) for k in rules]))
    return x.select(repo, F.when((F.size(named) == 0) & F.col("static"), F.array(F.lit("Static HTML"))).otherwise(named).alias("frameworks"))
