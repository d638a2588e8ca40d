"""Rule tables as data. The values below are fixed: results depend on every one of them."""

from __future__ import annotations

# fixed values: directories that a scan prunes
IGNORED_DIRS = ("node_modules", ".git", "target", "dist", "build", "coverage")

# fixed values: extension -> language
LANGUAGES = {
    "rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "py": "Python", "go": "Go",
    "sol": "Solidity", "css": "CSS", "scss": "CSS", "sass": "CSS", "html": "HTML", "htm": "HTML", "toml": "TOML", "json": "JSON", "yml": "YAML",
    "yaml": "YAML", "md": "Markdown", "markdown": "Markdown", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
}

# fixed values: package.json key -> label
NPM_FRAMEWORKS = {
    "react": "React", "next": "Next.js", "express": "Express", "vite": "Vite", "vue": "Vue", "nuxt": "Nuxt", "svelte": "Svelte", "astro": "Astro",
    "@nestjs/core": "NestJS", "fastify": "Fastify", "koa": "Koa", "hapi": "Hapi", "remix": "Remix", "gatsby": "Gatsby",
}
NPM_DATABASES = {
    "pg": "PostgreSQL", "postgres": "PostgreSQL", "mongoose": "MongoDB", "mongodb": "MongoDB", "mysql": "MySQL", "mysql2": "MySQL", "redis": "Redis",
    "ioredis": "Redis", "prisma": "Prisma", "@prisma/client": "Prisma", "better-sqlite3": "SQLite", "sqlite3": "SQLite", "knex": "Knex",
    "sequelize": "Sequelize", "typeorm": "TypeORM", "drizzle-orm": "Drizzle ORM", "cassandra-driver": "Cassandra", "couchdb": "CouchDB",
    "@elastic/elasticsearch": "Elasticsearch", "dynamoose": "DynamoDB",
}
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies")

# fixed values: requirements.txt name -> label
PIP_FRAMEWORKS = {
    "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "starlette": "Starlette", "tornado": "Tornado", "aiohttp": "aiohttp", "pyramid": "Pyramid",
    "sanic": "Sanic", "litestar": "Litestar",
}
PIP_DATABASES = {
    "sqlalchemy": "SQLAlchemy", "psycopg2": "PostgreSQL", "psycopg2-binary": "PostgreSQL", "psycopg": "PostgreSQL", "asyncpg": "PostgreSQL",
    "pymongo": "MongoDB", "motor": "MongoDB", "redis": "Redis", "aioredis": "Redis", "pymysql": "MySQL", "aiomysql": "MySQL", "mysqlclient": "MySQL",
    "tortoise-orm": "Tortoise ORM", "peewee": "Peewee", "databases": "Databases", "elasticsearch": "Elasticsearch", "cassandra-driver": "Cassandra",
}

# fixed values: Cargo.toml key -> label, and the sections that count
CARGO_FRAMEWORKS = {
    "tokio": "Tokio", "axum": "Axum", "actix-web": "Actix-web", "rocket": "Rocket", "warp": "Warp", "tonic": "Tonic", "poem": "Poem", "salvo": "Salvo",
    "tide": "Tide", "hyper": "Hyper", "tauri": "Tauri", "leptos": "Leptos", "dioxus": "Dioxus", "yew": "Yew",
}
CARGO_DATABASES = {
    "sqlx": "SQLx", "diesel": "Diesel", "sea-orm": "SeaORM", "tokio-postgres": "PostgreSQL", "postgres": "PostgreSQL", "mongodb": "MongoDB", "redis": "Redis",
    "rusqlite": "SQLite", "sled": "Sled", "elasticsearch": "Elasticsearch",
}
CARGO_SECTIONS = ("[dependencies]", "[dev-dependencies]", "[build-dependencies]", "[workspace.dependencies]")

# fixed values: go.mod substring -> label, the first that a line holds wins
GO_FRAMEWORKS = {
    "github.com/gin-gonic/gin": "Gin", "github.com/labstack/echo": "Echo", "github.com/gofiber/fiber": "Fiber", "github.com/gorilla/mux": "Gorilla Mux",
    "github.com/beego/beego": "Beego", "github.com/go-chi/chi": "Chi", "github.com/revel/revel": "Revel", "go.uber.org/fx": "Uber FX",
}

# fixed values: framework -> (extensions, substrings): a line with one of them uses the framework
USAGE = {
    "react": (
        ("ts", "tsx", "js", "jsx", "mjs"),
        ("from 'react'", 'from "react"', "from 'react-dom'", 'from "react-dom"', "require('react')", 'require("react")'),
    ),
    "next.js": (
        ("ts", "tsx", "js", "jsx"),
        ("from 'next'", 'from "next"', "from 'next/", 'from "next/', "require('next')", 'require("next")'),
    ),
    "express": (
        ("ts", "js", "mjs"),
        ("from 'express'", 'from "express"', "require('express')", 'require("express")'),
    ),
    "vite": (
        ("ts", "js", "mjs"),
        ("from 'vite'", 'from "vite"', "from 'vite/", 'from "vite/'),
    ),
    "vue": (
        ("ts", "tsx", "js", "jsx", "vue"),
        ("from 'vue'", 'from "vue"', "require('vue')", 'require("vue")'),
    ),
    "svelte": (
        ("ts", "js", "svelte"),
        ("from 'svelte'", 'from "svelte"', "from 'svelte/", 'from "svelte/'),
    ),
    "nestjs": (
        ("ts", "js"),
        ("from '@nestjs/", 'from "@nestjs/'),
    ),
    "fastify": (
        ("ts", "js", "mjs"),
        ("from 'fastify'", 'from "fastify"', "require('fastify')", 'require("fastify")'),
    ),
    "koa": (
        ("ts", "js", "mjs"),
        ("from 'koa'", 'from "koa"', "require('koa')", 'require("koa")'),
    ),
    "remix": (
        ("ts", "tsx", "js", "jsx"),
        ("from '@remix-run/", 'from "@remix-run/'),
    ),
    "gatsby": (
        ("ts", "tsx", "js", "jsx"),
        ("from 'gatsby'", 'from "gatsby"'),
    ),
    "nuxt": (
        ("ts", "js", "vue"),
        ("from 'nuxt'", 'from "nuxt"', "from '#app'", 'from "#app"'),
    ),
    "astro": (
        ("ts", "js", "astro"),
        ("from 'astro'", 'from "astro"', "from 'astro/", 'from "astro/'),
    ),
    "fastapi": (
        ("py",),
        ("from fastapi", "import fastapi"),
    ),
    "django": (
        ("py",),
        ("from django", "import django"),
    ),
    "flask": (
        ("py",),
        ("from flask", "import flask"),
    ),
    "starlette": (
        ("py",),
        ("from starlette", "import starlette"),
    ),
    "aiohttp": (
        ("py",),
        ("from aiohttp", "import aiohttp"),
    ),
    "tokio": (
        ("rs",),
        ("use tokio", "tokio::"),
    ),
    "axum": (
        ("rs",),
        ("use axum", "axum::"),
    ),
    "actix-web": (
        ("rs",),
        ("use actix_web", "actix_web::"),
    ),
    "rocket": (
        ("rs",),
        ("use rocket", "rocket::"),
    ),
    "warp": (
        ("rs",),
        ("use warp", "warp::"),
    ),
    "leptos": (
        ("rs",),
        ("use leptos", "leptos::"),
    ),
    "dioxus": (
        ("rs",),
        ("use dioxus", "dioxus::"),
    ),
    "yew": (
        ("rs",),
        ("use yew", "yew::"),
    ),
    "tauri": (
        ("rs",),
        ("use tauri", "tauri::"),
    ),
    "gin": (
        ("go",),
        ('"github.com/gin-gonic/gin"',),
    ),
    "echo": (
        ("go",),
        ('"github.com/labstack/echo',),
    ),
    "fiber": (
        ("go",),
        ('"github.com/gofiber/fiber',),
    ),
    "chi": (
        ("go",),
        ('"github.com/go-chi/chi',),
    ),
}

# fixed values: names of entry points
ENTRY_POINTS = (
    "main.rs", "lib.rs", "build.rs", "index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs",
    "server.ts", "server.js", "app.ts", "app.js", "main.ts", "main.js", "vite.config.ts", "vite.config.js",
    "next.config.ts", "next.config.js", "tailwind.config.ts", "tailwind.config.js", "jest.config.ts", "jest.config.js", "vitest.config.ts", "vitest.config.js",
    "webpack.config.js", "rollup.config.js", "app.py", "main.py", "run.py", "manage.py", "wsgi.py", "asgi.py",
    "__main__.py", "main.go", "cli.ts", "cli.js", "cli.rs",
)

# fixed values: labels that make a front end or a back end
FRONTEND = ("React", "Vue", "Next.js", "Nuxt", "Svelte", "Astro", "Remix", "Gatsby", "Angular")
BACKEND = ("Express", "FastAPI", "Django", "Flask", "Axum", "Actix-web", "Rocket", "NestJS", "Fastify", "Koa", "Gin", "Echo", "Fiber", "Tokio")

# fixed values: extensions that imports are resolved to
JS_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs")

# fixed values: beginnings of git URLs
GIT_PREFIXES = ("http://", "https://", "git@")

# fixed values: what a failed clone's message holds -> what is told; the first that fits
CLONE_ERRORS = (
    (("not found", "404", "403", "authentication", "could not read Username"), "Repository not found or access denied: {url}"),
    (("resolve", "connect", "timed out", "SSL", "network"), "Network error while cloning: {message}"),
    (("unsupported URL protocol", "invalid"), "Invalid repository URL: {url}"),
)
OTHER_CLONE_ERROR = "Failed to clone repository: {message}"
