"""Rule tables: word lists, patterns, weights and phrases that results depend on. All are fixed values."""

from __future__ import annotations

# --- fixed values: concept extraction
CONCEPT_STOPWORDS = (
    "about after also been before being between could does during each even from have here http https into just like make more most "
    "nbsp need only other over should some such than that their them then there these they this through time very was were what when "
    "where which while will with would your"
).split()
TECHNICAL_TERMS = (
    "kubernetes terraform docker graphql grpc oauth webhook microservice serverless observability latency throughput embeddings tokenizer "
    "retrieval inference finetuning finetuned quantization distillation api auth saas sdk cli iam sso rbac token cache queue proxy vault "
    "mesh cron cors csrf jwt tls mtls cicd devops"
).split()

# --- fixed values: titles
TITLE_PREFIXES = ("ask hn:", "show hn:", "tell hn:", "launch hn:")
WEAK_TITLE_TOKENS = (
    "the and for with that this from into your have been are was were will would could should about there their them they you our out how what "
    "when where why can more than just over under using need build make get use its not but has had let new way one two now ai saas tool tools "
    "app platform software solution product service system startup"
).split()
OPPORTUNITY_STOPWORDS = (
    "the and for with that this from into your have been are was were will would could should about there their them they you our out how what "
    "when where why can more than just over under using need build make get use ai saas tool tools"
).split()
OPPORTUNITY_KEYWORDS = "saas startup tool api platform automation software productivity workflow integration app service business market revenue customer problem".split()
ALWAYS_KEPT_SOURCES = ("hackernews", "github")

# --- fixed values: classes of pain, in order of precedence
PAIN_CLASSES = {
    "complaint": ("tired of", "hate that", "still broken", "why is .+ so hard", "painful", "frustrating", "nobody solves", "impossible to"),
    "workaround": ("built this because", "nothing existed", "we hacked together", "so i built", "had to roll our own", "wrote our own"),
    "request": ("looking for a tool", "does anyone know", "what do you use for", "any recommendations", "is there a saas", "best tool for"),
    "validation": ("paying .+ (and|but) still", r"\$\d+\/mo.+still", "vendor lock.?in", "switching from"),
    "job_signal": ("hiring.+(engineer|analyst|ops|manager)", "we('re| are) looking for.+(devops|data|ml)"),
}
PAIN_INTENSITY = {"validation": 30, "complaint": 26, "workaround": 24, "request": 18, "job_signal": 14}
OTHER_INTENSITY = 6
GAP_BY_CLASS = {"validation": 20, "workaround": 18, "complaint": 12}
STRONG_REQUEST, STRONG_REQUEST_GAP, OTHER_GAP = "looking for a tool|does anyone know|best tool for|is there a saas", 16, 4
BUSINESS_TERMS = "team|enterprise|workflow|compliance|security|ops|manager|developer|devops|finance|billing|analytics|automation|saas|api"

# --- fixed values: gaps, in order of precedence
GAP_TYPES = {
    "validated_demand": ("any tool", "looking for", "is there a way"),
    "diy_evidence": ("i built", "my script", "my workaround"),
    "emerging_interest": ("would love", "someone should build"),
}

# --- fixed values: trends; of equal counts the first wins
TRENDS = {
    "Access Control & Auth": ("auth", "login", "password", "oauth", "sso", "account", "restrict", "permission", "access"),
    "AI & LLM Tooling": ("ai", "llm", "gpt", "copilot", "assistant", "generate", "prompt"),
    "API & Integrations": ("api", "integration", "webhook", "sdk", "connect"),
    "Analytics & Reporting": ("analytics", "dashboard", "metric", "report", "insight", "tracking"),
    "Billing & Payments": ("billing", "payment", "subscription", "revenue", "pricing", "stripe"),
    "DevOps & Deployment": ("deploy", "devops", "ci", "pipeline", "docker", "kubernetes", "infra"),
    "Email & Notifications": ("email", "notification", "alert", "inbox", "smtp"),
    "Onboarding & Activation": ("onboard", "signup", "activation", "setup", "wizard"),
    "Search & Discovery": ("search", "filter", "query", "index", "elastic"),
    "Security & Compliance": ("security", "vulnerability", "cve", "exploit", "encrypt"),
    "Workflow Automation": ("workflow", "automation", "task", "schedule", "trigger", "zap"),
    "Mobile Development": ("mobile", "ios", "android", "react native", "flutter"),
    "Storage & Files": ("storage", "file", "upload", "cdn", "s3", "blob"),
    "Team & Collaboration": ("team", "collaboration", "workspace", "permission", "role"),
    "Testing & Observability": ("test", "qa", "debug", "error", "monitor", "log", "observ"),
}
MACRO_DRIVERS = {
    "ai_adoption": ("ai", "llm", "gpt", "copilot", "ml", "model", "prompt", "agent", "embedding"),
    "regulatory_pressure": ("compliance", "gdpr", "hipaa", "audit", "security", "permission", "access", "rbac", "soc2"),
    "cost_reduction": ("cost", "expensive", "pricing", "bill", "reduce", "cheap", "afford", "budget"),
    "developer_tooling": ("sdk", "api", "cli", "library", "framework", "integration", "webhook", "devtools"),
    "remote_work": ("remote", "async", "distributed", "team", "collaboration", "timezone", "hybrid"),
    "platform_shift": ("mobile", "wasm", "edge", "serverless", "cloud", "kubernetes", "container", "runtime"),
}

# --- fixed values: keyword groups and pain phrases of each feed
FEED_KEYWORDS = {
    "reddit": (
        "SaaS|B2B|B2C|MVP|API|automation|platform|marketplace|subscription|freemium|growth|scaling|user acquisition|retention|churn|analytics|ai|ml|machine learning|blockchain|web3|crypto|app|tool|service|product",
        "founder|startup|business|idea|launch|build|ship|beta|alpha|open source|bootstrapped|vc|venture capital|seed|series [a-z]",
        "revenue|monetization|pricing|features|development|engineering|design|ux|ui|marketing|sales",
    ),
    "hackernews": (
        "ai|ml|machine learning|deep learning|llm|gpt|transformer|neural|algorithm",
        "startup|founder|bootstrap|vc|venture|seed|series [a-z]|acquisition|unicorn",
        "saas|b2b|api|platform|tool|framework|library|sdk|open source",
        "automation|productivity|workflow|integration|pipeline|deployment",
        "devops|infrastructure|cloud|server|database|cache|kubernetes|docker",
        "web3|crypto|blockchain|defi|nft|solana|ethereum",
        "security|privacy|encryption|authentication|compliance",
    ),
    "producthunt": (
        "ai|ml|machine learning|automation|assistant|chatbot|agent",
        "saas|app|software|tool|platform|service|integration",
        "analytics|data|dashboard|reporting|metric",
        "productivity|collaboration|workflow|management|organization",
        "design|creative|ui|ux|interface",
        "development|code|programming|devops|backend|frontend",
        "marketing|sales|crm|lead|customer|commerce|ecommerce",
        "security|privacy|encryption|identity",
    ),
}
MOST_KEYWORDS = 8
FEED_PAINS = {
    "reddit": {
        "Implementation difficulty": "struggling|struggling with|problem with|issue with|can't|can not|difficult|hard to",
        "Unmet need or knowledge gap": "need|looking for|searching for|want|how to",
        "Cost": "expensive|costly|high cost|too much",
        "Performance": "slow|speed|performance|latency|delay",
        "User experience": "complicated|complex|confusing|unclear",
        "Security/Privacy": "spam|security|privacy|safe|protection|attack",
        "Time/Efficiency": "time consuming|manual|repetitive|automation|busy|overwhelmed",
    },
    "hackernews": {
        "Reliability": "problem|issue|bug|crash|error|failing|broken",
        "Performance": "slow|performance|latency|optimization|fast",
        "Security": "security|vulnerability|breach|exploit|attack",
        "Complexity": "complex|difficult|hard|learning curve|confusing",
        "Cost": "expensive|cost|price|billing|payment",
        "Scalability": "scaling|scale|growth|load|capacity",
        "Efficiency": "automat|manual|repetitive|workflow|process",
    },
    "producthunt": {
        "Time/Speed": "faster|speed|quick|instant|real-time",
        "Simplicity": "simple|easy|no-code|low-code|automated",
        "Collaboration": "collaborative|team|sync|share",
        "Information Gap": "data|insight|intelligence|analytics|metric",
        "Organization": "organize|manage|track|monitor|control",
        "Integration": "connect|integrate|api|workflow|automate",
        "Security": "secure|safe|private|protect|compliance",
        "Scalability": "scale|growth|handle|performance",
    },
}

# --- fixed values: quality of a signal
NOISE_TERMS = ("hiring", "job", "salary", "who is", "what is", "how to", "tutorial", "course", "learn", "beginner")

# --- fixed values: opportunities
MONETIZATION = {
    "Implementation difficulty": ("Freemium + $29/mo team plan", 4),
    "Unmet need or knowledge gap": ("Free newsletter + $19/mo premium", 3),
    "Cost": ("$19-$49/mo subscription", 5),
    "Performance": ("Usage-based + pro plan", 7),
    "User experience": ("Freemium + Pro + Team", 4),
    "Security/Privacy": ("$49/mo pro or self-hosted license", 6),
    "Time/Efficiency": ("Per-seat pricing + automation credits", 5),
}
OTHER_MONETIZATION = ("$29-$79/mo subscription", 5)
CATEGORIES = "workflow automation monitoring analytics compliance security payments billing reporting scheduling authentication authorization observability alerting agents ai devtools integration".split()
FALLBACK_KEYWORDS = ("workflow automation", "team collaboration", "data analytics", "api integration", "monitoring", "compliance")
AGENT_PAINS = (
    (("sandbox", "safehouse"), "testing and sandboxing AI agents safely"),
    (("debug", "error"), "debugging AI agent failures and prompt issues"),
    (("monitor", "tracking"), "monitoring AI agent behaviour in production"),
    (("workflow", "automation"), "orchestrating multi-agent workflows"),
    (("prompt",), "optimising prompts across AI agents"),
    (("agent",), "managing and orchestrating AI agents"),
)
TARGET_MARKETS = (
    (("developer", "coding", "programming"), "Software developers and engineering teams"),
    (("enterprise", "business"), "Enterprise organizations and business teams"),
    (("startup", "founder"), "Startups and early-stage companies"),
    (("data", "analytics", "ai"), "Data teams and AI practitioners"),
    (("security", "compliance"), "Security teams and compliance officers"),
    (("saas", "cloud"), "SaaS companies and cloud-native organizations"),
)
OTHER_MARKET = "Technology teams and product builders"
CLUSTER_PAINS = (
    (("productivity",), "Teams struggle with inefficient workflows and context switching that hampers productivity and slows down delivery."),
    (("monitoring", "observability"), "Organizations lack visibility into system behavior, making it difficult to debug issues and ensure reliability."),
    (("automation",), "Manual, repetitive tasks consume valuable time and introduce human error, limiting team scalability."),
    (("security",), "Security vulnerabilities and compliance requirements create risk and slow down development cycles."),
    (("data", "analytics"), "Teams struggle to extract insights from growing data volumes and make data-driven decisions effectively."),
    (("collaboration",), "Distributed teams face challenges coordinating work and maintaining alignment across different tools and timezones."),
    (("deployment", "infrastructure"), "Complex deployment processes and infrastructure management create bottlenecks and reduce deployment frequency."),
)
WHY_NOW = {
    "velocity": ((15, "Rapidly accelerating interest across multiple communities"), (8, "Growing momentum and community adoption")),
    "diversity": ((4, "Strong signals across diverse sources (HackerNews, Reddit, GitHub, ProductHunt)"), (3, "Validated by multiple independent communities")),
    "score": ((60, "High-quality discussions indicate genuine market need"), (45, "Emerging pattern with strong early validation")),
    "concepts": ("Multiple interconnected concepts suggest a maturing ecosystem", "Core concepts are crystallizing into actionable patterns"),
}
RATE_LIMIT_MARKS = ("429", "RATELIMIT_EXCEEDED", "quota", "rate limit")
PLAN_CAPS = {"free": 3, "founder": 20, "pro": 100, "agency": None}

# How a trend is named by category and qualifier, and words that qualify nothing.
CATEGORY_PREFIXES = {
    "ai": "AI", "automation": "Workflow Automation", "fintech": "Fintech", "devtools": "Developer Tooling", "compliance": "Compliance", "analytics": "Analytics", "payments": "Payments",
}
QUALIFIERS = {
    "pull request": "Code Review", "pull requests": "Code Review", "code review": "Code Review", "compliance report": "Compliance", "compliance reporting": "Compliance", "compliance": "Compliance",
    "customer support": "Customer Support", "support team": "Customer Support", "developers": "Developers", "dev team": "Developers", "small business": "Small Businesses", "reporting": "Reporting",
    "audit": "Audit & Compliance", "data pipeline": "Data Pipelines", "api": "API Integrations", "saas": "SaaS Teams", "startup": "Startups", "enterprise": "Enterprise Teams",
}
NOISE_WORDS = ("new", "ship", "launch", "release", "update", "v1", "v2", "beta", "alpha", "oss", "open", "free", "my", "our", "we", "i", "the")
QUALIFIER_PATTERNS = (r"\bfor\s+([a-z][a-z\s]{2,40})", r"\bto\s+([a-z][a-z\s]{2,35})", r"\bbuilt\s+for\s+([a-z][a-z\s]{2,35})", r"\bthat\s+([a-z][a-z\s]{2,30})")
# Texts about an opportunity, with what is put into them.
EXPLANATION = 'Signals from {source} suggest growing demand for tools solving "{pain}". Strong signal around {keyword}.'
IDEA = 'Build a SaaS platform focused on "{pain}". Start with a simple product helping teams handle this problem faster and expand with analytics, automation and integrations.'
PREDICTION = "Prediction: {title} will gain significant traction in the next 3-6 months based on emerging signals across {sources}."
METHODOLOGY = (
    "## Prediction Methodology\n\n**Opportunity Score:** {score}/100\n**Signal Count:** {count}\n**Signal Sources:** {sources}\n\n### Signal Breakdown\n\n{signals}\n\n"
    "### Key Indicators\n- High engagement across multiple platforms\n- Growing discussion volume\n- Cross-platform signal convergence\n\n*Auto-generated at {at}*"
)
SIGNAL_LINE = "{place}. **{source}**: {title} (score: {score}, comments: {comments})"
