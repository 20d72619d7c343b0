"""Categories of console errors that come from testing a page away from home, not from its code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import first_match

# Category and the texts that show it; the first text found decides, letter case counts.
NOISE = {
    "cors": ["Access-Control-Allow-Origin", "has been blocked by CORS", "CORS policy", "blocked by CORS", "No 'Access-Control-Allow-Origin'", "Cross-Origin-Resource-Policy"],
    "domain_lock": [
        "only be used on https://", "only be used on http://", "Your current origin is http://localhost", "Your current origin is https://localhost",
        "not allowed on this domain", "not authorized for this domain", "not authorized to use this domain", "domain is not registered",
        "domain is not whitelisted", "domain mismatch", "Invalid domain", "allowed domains", "allowed origins", "origin is not allowed",
        "origin not allowed", "This origin is not allowed",
    ],
    "mixed_content": ["Mixed Content", "was loaded over HTTPS, but requested an insecure", "blocked because the page was loaded over HTTPS", "insecure content"],
    "secure_context": [
        "ServiceWorker", "navigator.serviceWorker", "Service workers are not allowed", "The operation is insecure", "only available in secure contexts",
        "requires a secure context", "only available on HTTPS", "secure context required", "SecurityError", "Failed to register a ServiceWorker",
        "DOMException: Failed to register",
    ],
    "ssl": ["net::ERR_CERT", "net::ERR_SSL", "ERR_CERT_AUTHORITY_INVALID", "ERR_CERT_COMMON_NAME_INVALID"],
    "fb_sdk": ["Given URL is not allowed by the Application", "App domain", "Can't load URL", "This domain is not registered", "Invalid App ID"],
    "google_sdk": [
        "RefererNotAllowedMapError", "ApiNotActivatedMapError", "InvalidKeyMapError", "Not a valid origin for the client", "redirect_uri_mismatch",
        "Invalid site key", "reCAPTCHA placeholder", "grecaptcha.execute", "Google Maps JavaScript API error",
    ],
    "auth_sdk": [
        "Not authorized to redirect", "redirect_uri is not registered", "redirect_uri is not whitelisted", "Invalid callback URL", "Callback URL mismatch",
        "Hostname ... is not authorized", "is not authorized to run this operation", "auth/unauthorized-domain", "unauthorized domain",
    ],
    "payment_sdk": ["Invalid domain for Stripe", "This domain is not enabled", "PayPal SDK: This environment", "not approved for production"],
    "analytics": ["Tracking pixel", "pixel not configured", "Tag not found"],
    "analytics_ws": ["WebSocket connection to 'wss://mc.yandex.ru", "WebSocket connection to 'wss://ws.hotjar.com", "WebSocket connection to 'wss://in.hotjar.com"],
    "maps": ["Mapbox", "mapboxgl", "token is not authorized"],
    "cookie": ["SameSite", "Secure attribute", "set-cookie", "partitioned cookies", "cross-site cookie"],
    "browser_intervention": [
        "Intervention:", "[Intervention]", "ResizeObserver loop limit exceeded", "ResizeObserver loop completed with undelivered notifications",
        "Blocked attempt to show a 'beforeunload'",
    ],
    "csp": [
        "Content Security Policy", "Refused to load the script", "Refused to load the stylesheet", "Refused to execute inline script",
        "Refused to execute inline event handler", "violates the following Content Security Policy",
    ],
}


def noise(message: Column) -> Column:
    """The category of the first pattern, in the order of the table, that a message holds; null for none."""
    return first_match([(F.exists(F.array(*map(F.lit, texts)), lambda t: F.contains(message, t)), name) for name, texts in NOISE.items()], None)
